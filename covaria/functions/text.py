"""Text expressions: Column in, Column out, evaluated inside the JVM."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the note normaliser.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all
any both each few more most other some such no nor not only own same so than too
very s t can will just don don't should should've now d ll m o re ve y ain aren
aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven
haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()

# The 32 ASCII punctuation characters, and the characters that
# separate words (ASCII and Unicode white space, file and record separators).
PUNCTUATION = string.punctuation
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# A run of word characters, or one other visible character.
RAW_TOKEN = (
    r"[\p{L}\p{M}\p{N}_]+|"
    r"[^\p{L}\p{M}\p{N}_\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Name given to each symbol by the delimiter cleaner.
SYMBOL_NAMES = {
    "~": "_symbol_tilde_",
    "@": "_symbol_at_",
    "#": "_symbol_hash_",
    "%": "_symbol_percent_",
    "&": "_symbol_and_",
    "*": "_symbol_asterisk_",
    "(": "_symbol_open_parenthesis_",
    ")": "_symbol_close_parenthesis_",
    "+": "_symbol_plus_",
    "=": "_symbol_equals_",
    "\\": "_symbol_backslash_",
    "?": "_symbol_question_mark_",
    "/": "_symbol_forwardslash_",
    ">": "_symbol_greater_than_",
    "<": "_symbol_less_than_",
    ":": "_symbol_colon_",
    ";": "_symbol_semicolon_",
    "'": "_symbol_apostrophe_",
    '"': "_symbol_quotation_",
}
HYPHEN = (" - ", " symbol_hyphen ")
PERIOD = "_symbol_period_"
PERIOD_AT_END = "_symbol_period,"
DECIMAL = "_symbol_decimal_"
SPARE_COMMA = (
    ",,,,100_symbol_percent_taken,,,,,,,",
    ",,,100_symbol_percent_taken,,,,,,,",
)


def words(text: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def without(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Drop listed words; a long literal list becomes one hash-set lookup."""
    return F.filter(tokens, lambda w: ~w.isin(*stop_words)) if stop_words else tokens


def without_first_line(text: Column) -> Column:
    """Text after the first line break; a one-line note has an empty body."""
    return F.regexp_extract(text, r"(?s)\n(.*)", 1)


def note_body(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased body without stop words, then without punctuation.

    Stop words go first, so ``the,`` survives as ``the``.
    """
    kept = F.array_join(without(words(without_first_line(F.lower(text))), stop_words), " ")
    return F.regexp_replace(kept, r"\p{Punct}", "")


def body_tokens(body: Column) -> Column:
    """Tokens of a normalised body, whose words are parted by single spaces."""
    return F.filter(F.split(body, " "), lambda w: w != "")


def raw_tokens(text: Column) -> Column:
    """Lower-cased words and single symbols of the unchanged note."""
    return F.regexp_extract_all(F.lower(text), F.lit(RAW_TOKEN), F.lit(0))


def topic_tokens(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Tokens for topic models: no punctuation, digits, stop words or short words."""
    letters = F.regexp_replace(F.lower(text), r"[0-9]+", "")
    pieces = F.split(letters, rf"(?:\p{{Punct}}|{WHITESPACE[:-1]})+")
    return F.filter(
        pieces, lambda w: (F.length(w) >= 3) & ~w.isin(*stop_words)
    )


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined windows of ``n`` neighbouring tokens; empty when too short."""
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    joined = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        joined = F.zip_with(
            joined, F.slice(tokens, F.lit(shift + 1), count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return F.when(count > 0, joined).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences, cut at white space that follows ``.``, ``!`` or ``?``."""
    return F.split(text, r"(?<=[.!?])" + WHITESPACE)


def _named(line: Column, symbols: Sequence[str]) -> Column:
    """Every one of ``symbols`` as its name; the line is cut once, whatever their number."""
    listed = "".join(f"\\{s}" for s in symbols)
    pieces = F.regexp_extract_all(line, F.lit(rf"[{listed}]|[^{listed}]++"), F.lit(0))
    names = F.create_map(*[F.lit(x) for s in symbols for x in (s, SYMBOL_NAMES[s])])
    named = F.transform(
        pieces, lambda p: F.when(F.octet_length(p) == 1, F.coalesce(F.try_element_at(names, p), p)).otherwise(p)
    )
    return F.array_join(named, "")


def clean_delimiters(
    line: Column,
    literal_period: bool = False,
    header: bool = False,
    join_leukemia: bool = False,
) -> Column:
    """Spell out the symbols of one line of a delimited term file.

    Every pass over a line costs, so rules that touch no sign of each other share one, and rules
    whose matches overlap look at their neighbours without taking them. ``join_leukemia`` drops
    the stray comma in ``leukemia ,`` before anything else.
    """
    if header:
        out = F.replace(line, F.lit(" "), F.lit(""))
    else:
        out = F.replace(line, F.lit("leukemia ,"), F.lit("leukemia")) if join_leukemia else line
        for spaced_comma in (" , ", ", ", " ,"):
            out = F.replace(out, F.lit(spaced_comma), F.lit(" "))
        out = F.replace(out, F.lit('"'), F.lit(""))
        # No rule makes a spaced hyphen or a spaced sign, and a header has no spaces.
        out = F.regexp_replace(out, f"{HYPHEN[0][:-1]}(?= )", HYPHEN[1][:-1])
    out = _named(out, list(SYMBOL_NAMES))
    if not header:
        out = F.regexp_replace(out, r" \. " if literal_period else " . ", PERIOD)
        out = F.replace(out, F.lit(f" {PERIOD},"), F.lit(PERIOD_AT_END))
    out = F.regexp_replace(out, r"(?<=[0-9])\.(?=[0-9])", DECIMAL)
    # Four underscores in a row are one.
    out = F.regexp_replace(out, r"[^\p{L}\p{N},.\-]{1,4}", "_")
    for _ in range(2):
        out = F.replace(out, F.lit(SPARE_COMMA[0]), F.lit(SPARE_COMMA[1]))
    return out


def decimal_mark(name: Column) -> Column:
    """Spell out the first full stop of a name."""
    return F.regexp_replace(name, r"^([^.]*)\.", rf"$1{DECIMAL}")


def clean_name(name: Column) -> Column:
    """Snake-case ASCII name; duplicates stay duplicates."""
    out = F.translate(name, "'\"", "")
    out = F.replace(out, F.lit("%"), F.lit("_percent_"))
    out = F.replace(out, F.lit("#"), F.lit("_number_"))
    # Letters with marks and their plain forms.
    out = F.translate(
        out,
        "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
        "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy",
    )
    out = F.regexp_replace(out, r"([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, r"([A-Z])([A-Z][a-z])", "$1_$2")
    out = F.regexp_replace(out, r"[^A-Za-z0-9]+", "_")
    out = F.lower(F.regexp_replace(out, r"^_+|_+$", ""))
    return F.regexp_replace(out, r"^([0-9])", "x$1")
