"""Character classes and word lists, once for all operators. Patterns are in Java's dialect."""

#: White space, as a class body.
WS_BODY = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS, NOT_WS = f"[{WS_BODY}]", f"[^{WS_BODY}]"
#: Line ends, CRLF as one.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SYMBOL = r"[^\p{L}\p{M}\p{N}\p{P}\r\n\t]"
#: The same sets, laid out for Java: single Latin-1 characters are one table, all others lie behind one range test.
FAST_WS_BODY = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
FAST_WS, FAST_NOT_WS, FAST_WS_NOT_SPACE = f"[{FAST_WS_BODY}]", f"[^{FAST_WS_BODY}]", f"[{FAST_WS_BODY.replace(r'\x20', '')}]"
FAST_LINE_END = r"[\n\x0B\f\r\x1C\x1D\x1E\x85\x{2028}-\x{2029}](?:(?<=\r)\n)?"
#: Characters of WS, and the line ends other than LF.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SYMBOL_NOT_SPACE = r"[^a-zA-Z ,.\p{L}\p{M}\p{N}\p{P}\r\n\t]"
WORD = r"[\p{L}\p{Nl}\p{No}]+(?:[-\x27][\p{L}\p{Nl}\p{No}]+)*"
FAST_WORD = r"[a-zA-Z\p{L}\p{Nl}\p{No}]++(?:[-\x27][\p{L}\p{Nl}\p{No}]++)*+"
WORD_RUN = r"[\p{L}\p{N}_’\x27]+"
TERMINATORS = ".!?…"
CLOSERS = "\"'”’»)"
LEADING_CLOSERS = "»”’\"'\\)\\]\\}"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]"
FAST_CJK = rf"[\x{{3040}}-\x{{FF9F}}&&{CJK}]"

#: Short words that count as significant.
SHORT_WORDS = ("я", "ты", "он", "она", "оно", "мы", "вы", "они", "i", "you", "he", "she", "it", "we", "they")
#: Interface lines of forum pages; the first two announce a vote count.
UI_LINES = (
    "Нравится", "Не нравится", "Ответить", "Награда", "Поделиться", "Перейти к комментариям", "Вступить в беседу",
    "Сортировка по:", "Лучшие", "Найти комментарии", "Развернуть поиск по комментариям", "Посмотреть всех модераторов",
)
#: Words that begin a sentence where punctuation is missing.
SENTENCE_STARTS = ("I", "We", "You", "He", "She", "It", "They", "This", "That", "There", "Here", "The", "A", "An", "But", "And", "So", "Then", "Still", "Hell", "Yeah")

#: Subtitle and forum lines, URLs and references (whole-line patterns on trimmed lines).
TIME = r"(?:\p{Nd}{1,2}:)?\p{Nd}{2}:\p{Nd}{2}[,.]\p{Nd}{1,3}"
TIMING_LINE = f"{TIME}{WS}*-->{WS}*{TIME}(?:{WS}+.*)?"
INDEX_LINE = r"\p{Nd}+"
AVATAR_LINE = "Аватар u/[A-Za-z0-9_-]+"
USER_LINE = "[A-Za-z0-9_][A-Za-z0-9_-]{1,31}"
AGO_LINE = rf"\p{{Nd}}+{WS}*(?:дн\.|ч\.|мин\.|сек\.){WS}+назад"
REPLIES_LINE = rf"Еще{WS}+\p{{Nd}}+{WS}+ответ(?:ов|а)?"
_BADGE = r"(?:Значок профиля за достижение|Комментатор из топ-\p{Nd}+%)"
BADGE_LINE = f"{_BADGE}(?:{WS}+{_BADGE})*"
COMMUNITY = "(?i)[ru]/[A-Za-z0-9_][A-Za-z0-9_-]{1,31}"
WEEKLY = f"(?iu)опубликованных{WS}+материалов{WS}+за{WS}+неделю"
URL = rf"(?i)(?:https?://|www\.){NOT_WS}"
FAST_URL = rf"(?=[hHwW])(?i:https?://|www\.){FAST_NOT_WS}"
MODERATORS = "посмотреть всех модераторов"
