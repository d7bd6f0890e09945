"""Column expressions on text. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Every blank that Unicode text splitting knows, plus the four separator controls.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
WORDS = r"(?U)\w{2,}"
FIELD_SEPARATOR = " ||| "


def or_default(column: Column, default: str = "") -> Column:
    return F.coalesce(column, F.lit(default))


def combine(columns: Sequence[Column]) -> Column:
    """Fields joined by one blank. NULL counts as '', so the blanks around it stay."""
    return F.concat_ws(" ", *[or_default(c) for c in columns])


def squeeze(column: Column) -> Column:
    return F.regexp_replace(column, BLANKS, " ")


def normalise(column: Column) -> Column:
    """Lower case, each run of blanks to one, none at either end; NULL becomes ''."""
    return F.trim(squeeze(F.lower(or_default(column))))


def field_signature(columns: Sequence[Column]) -> Column:
    """SHA-1 over the separately normalised fields."""
    return F.sha1(F.concat_ws(FIELD_SEPARATOR, *[normalise(c) for c in columns]))


def text_signature(columns: Sequence[Column]) -> Column:
    """SHA-1 over the normalised combination of the fields."""
    return F.sha1(normalise(combine(columns)))


def characters(column: Column) -> Column:
    return F.length(or_default(column))


def word_count(column: Column) -> Column:
    return F.size(F.filter(F.split(or_default(column), BLANKS), lambda w: w != ""))


def presence(column: Column) -> Column:
    return column.isNotNull().cast("int")


def snippet(column: Column, size: int, squeeze_blanks: bool = True) -> Column:
    text = or_default(column)
    return F.substring(squeeze(text) if squeeze_blanks else text, 1, size)


def slugify(column: Column) -> Column:
    parts = F.regexp_replace(column.cast("string"), "[^a-zA-Z0-9_]+", "_")
    return F.lower(F.regexp_replace(parts, "^_+|_+$", ""))


def short_label(column: Column, value: Column, size: int = 35) -> Column:
    return F.concat(column, F.lit(": "), F.substring(value, 1, size))


def readable_feature(column: Column) -> Column:
    """``text__x`` to ``text: x``, ``categorical__x`` to ``category: x``, ``numeric__x`` to ``numeric: x``."""
    for prefix, shown in (("text__", "text: "), ("categorical__", "category: "), ("numeric__", "numeric: ")):
        column = F.replace(column, F.lit(prefix), F.lit(shown))
    return column


def words(column: Column) -> Column:
    """Lower-case words of at least two word characters."""
    return F.regexp_extract_all(F.lower(or_default(column)), F.lit(WORDS), F.lit(0))


def without(tokens: Column, stop_words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(list(stop_words)))


def bigrams(tokens: Column) -> Column:
    """Neighbouring pairs of tokens; empty below two tokens."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    leading = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(leading, following, lambda a, b: F.concat(a, F.lit(" "), b))


def unigrams_and_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))


# The English stop words shipped with Spark ML. Any other list may be passed instead.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
