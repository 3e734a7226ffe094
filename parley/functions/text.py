"""Text expressions for transcripts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as alphanumeric in a word.
NOT_ALNUM = "[^\\p{IsAlphabetic}\\p{N}]"
MAX_WORDS = 400


def words(text: Column) -> Column:
    """Words for comparison: split at white space, only alphanumerics, lower case, ё as е, no empty ones."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda w: F.translate(F.lower(F.regexp_replace(w, NOT_ALNUM, "")), "ё", "е"))
    return F.filter(parts, lambda w: w != "")


def tokens(text: Column) -> Column:
    """Tokens for mining: split at everything not alphanumeric, case kept."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{NOT_ALNUM}+"), lambda w: w != "")


def bare(word: Column) -> Column:
    """A word as the diff compares it: without other characters at its ends, lower case."""
    return F.lower(F.regexp_replace(word, f"^{NOT_ALNUM}+|{NOT_ALNUM}+$", ""))


def plain(text: Column) -> Column:
    """Lower case, other characters as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[^\\p{IsAlphabetic}\\p{N}\\s]", " ")), "\\s+", " "))


#: Characters that stand for the words that two texts share, after one for all other words of a side.
_SHARED = "".join(chr(0x4E00 + i) for i in range(MAX_WORDS))
#: Lists that longer texts' shared words are dealt to by a hash, so that a word is sought in one of them.
_LISTS = 64


def word_similarity(a: Column, b: Column, most: int | None = MAX_WORDS) -> Column:
    """1 - distance / longer length of two word arrays by word-level edit distance; 0 if either is empty.

    Words become characters, so that the built-in edit distance of strings counts words: a word that
    both sides have by its place among those, any other by a character of its side, since it can
    match nothing. Only the first ``most`` words count, or all where it is None; then about a million
    different words may be shared, and more are an error.
    """
    if most is not None and most > MAX_WORDS:
        raise ValueError(f"at most {MAX_WORDS} words are compared")

    def coded(side: Column, shared: Column, own: str) -> Column:
        return F.array_join(F.transform(side, lambda w: F.substring(F.lit(own + _SHARED), F.array_position(shared, w).cast("int") + 1, F.lit(1))), "")

    def dealt(word: Column) -> Column:
        return F.pmod(F.hash(word), F.lit(_LISTS))

    def coded_by_number(side: Column, lists: Column, own: int) -> Column:
        def code(w: Column) -> Column:
            place = F.array_position(F.get(lists, dealt(w)), w)
            number = F.when(place == 0, F.lit(own)).otherwise((place - 1) * _LISTS + dealt(w) + 3)
            # Past the surrogates and the byte order mark, which are no characters.
            return F.lpad(F.hex(F.when(number < 0xD800, number).otherwise(number + 0x2800)), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(side, code), "")), "UTF-32")

    def distance(s: Column) -> Column:
        short = F.levenshtein(coded(s["a"], s["k"], "<"), coded(s["b"], s["k"], ">"))
        if most is not None:
            return short
        lists = F.array(F.transform(F.sequence(F.lit(0), F.lit(_LISTS - 1)), lambda i: F.filter(s["k"], lambda w: dealt(w) == i)))
        long = F.get(F.transform(lists, lambda k: F.levenshtein(coded_by_number(s["a"], k, 1), coded_by_number(s["b"], k, 2))), F.lit(0))
        return F.when(F.size(s["k"]) <= MAX_WORDS, short).otherwise(long)

    def similarity(s: Column) -> Column:
        longer = F.greatest(F.size(s["a"]), F.size(s["b"]))
        return F.when(F.size(s["k"]) == 0, 0.0).otherwise(1 - distance(s) / longer)

    left, right = (a, b) if most is None else (F.slice(a, 1, most), F.slice(b, 1, most))
    # One element, so that the shared words are found once for a pair and not once for each word.
    pair = F.array(F.struct(left.alias("a"), right.alias("b"), F.array_intersect(left, right).alias("k")))
    return F.get(F.transform(pair, similarity), F.lit(0))


def word_overlap(a: Column, b: Column) -> Column:
    """A10: twice the common words over all words, words counted as often as they occur; 0 without words."""
    both = F.array_distinct(F.array_intersect(a, b))
    count = lambda side, w: F.size(F.filter(side, lambda x: x == w))
    common = F.aggregate(both, F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2 * common / total)


def likeness(a: Column, b: Column) -> Column:
    """Common distinct words over the larger number of distinct words; 0 without words."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def ends_sentence(text: Column) -> Column:
    """X11: whether the last character, white space aside, ends a sentence."""
    return text.rlike("[.!?…]\\s*$")


def is_latin(token: Column) -> Column:
    """A letter, and ASCII letters only."""
    return token.rlike("[A-Za-z]") & ~F.regexp_replace(token, "[A-Za-z]", "").rlike("\\p{IsAlphabetic}")


def is_acronym(token: Column) -> Column:
    """Two letters or more, all upper case."""
    letters = F.regexp_replace(token, "[^\\p{IsAlphabetic}]", "")
    return (F.length(letters) >= 2) & letters.rlike("^\\p{Lu}+$")


def shortened(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\\n\\s*\\n"), F.trim), lambda p: p != "")


def bullets(items: Column) -> Column:
    """A list with a bullet before each item."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def has_cue(text: Column, cues: list[str]) -> Column:
    """Whether a lower-case cue occurs in the text."""
    low = F.lower(text)
    found = F.lit(False)
    for cue in cues:
        found = found | low.contains(cue)
    return found


def numbered(lines: Column) -> Column:
    """An array of lines as a numbered batch."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def parse_numbered(reply: Column, n: Column) -> Column:
    """Lines of a numbered batch in order, or null where the reply is not exactly 1 to n, each once and not empty."""
    found = F.filter(F.transform(F.split(reply, "\\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^(\\d{1,6})[.)]\\s*(.*)$", 1).alias("k"), F.trim(F.regexp_extract(x, "^(\\d{1,6})[.)]\\s*(.*)$", 2)).alias("v")))
    numbers = F.transform(parts, lambda p: F.when(p["k"] != "", p["k"].cast("int")))
    sound = (F.size(parts) == n) & F.forall(parts, lambda p: (p["k"] != "") & (p["v"] != "")) & (F.array_sort(numbers) == F.sequence(F.lit(1), n))
    in_order = F.array_sort(F.transform(parts, lambda p: F.struct(p["k"].cast("int").alias("k"), p["v"])))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(in_order, lambda p: p["v"]))


#: What a speech model writes on silence, after ``plain``; the stem of credits and its verbs are below.
MARKERS = (
    "авторы субтитров", "автор субтитров", "редактор субтитров", "переводчик субтитров",
    "dimatorzok", "дима торжок", "димасторжок", "игорь негода",
    "продолжение следует", "подписывайтесь на канал", "спасибо за просмотр", "спасибо за внимание всем", "ставьте лайк",
    "пара имен", "корректор а", "амara org", "amara org",
    "thanks for watching", "thank you for watching", "subscribe to", "subtitles by", "字幕", "www ", "http",
)
CREDIT_STEM = "субтитр"
CREDIT_VERBS = (
    "сделал", "делал", "создал", "создавал", "добавил", "подготовил", "подогнал", "подгонял",
    "перевел", "перевёл", "правил", "редактировал", "озвучил", "предоставлены", "и перевод",
)
CREDIT_WORDS, CREDIT_PREFIX_WORDS = 4, 2
MIN_PREFIX = 5


def _credits(low: Column) -> Column:
    """A credit verb, as whole words, within the four words after the stem of the credits."""
    between = f"{CREDIT_STEM}\\S*(?: \\S+){{0,{CREDIT_WORDS - 1}}}? "
    single = "|".join(v for v in CREDIT_VERBS if " " not in v)
    return low.rlike(f"{between}(?:{single})(?: |$)") | low.rlike(f"{CREDIT_STEM}\\S*(?: \\S+){{0,{CREDIT_WORDS - 2}}}? и перевод(?: |$)")


def is_hallucination(text: Column) -> Column:
    """text that a speech model writes on silence: under two characters, a credits line or a known marker."""
    low = plain(text)
    found = (F.length(low) < 2) | _credits(low)
    for marker in MARKERS:
        found = found | low.contains(marker)
    return F.coalesce(found, F.lit(True))


def may_become_hallucination(text: Column) -> Column:
    """text of five characters or more that begins a marker, or that is a stem of credits without its verb."""
    low = plain(text)
    found = low.startswith(CREDIT_STEM) & (F.size(F.split(low, " ")) <= CREDIT_PREFIX_WORDS) & ~_credits(low)
    for marker in MARKERS:
        found = found | ((F.octet_length(low) < len(marker.encode())) & F.lit(marker).startswith(low))
    return F.coalesce((F.length(low) >= MIN_PREFIX) & found, F.lit(False))


def prefix_query(query: str) -> list[str]:
    """The words of a search, lower case; each must begin some word of a text. A blank query has none."""
    import re

    return [w.lower() for w in re.findall(r"[^\W_]+", query)]
