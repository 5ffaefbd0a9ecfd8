"""Text scalar functions: normalising, tokenising and per-document bags of words.

Everything here is a Column expression over one row, so it stays inside the
scan stage: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Stop words of the filtered tokeniser. Words with an apostrophe can never
# match a token, because punctuation is replaced before the text is split.
STOPWORDS = frozenset(
    """
    a about above after again against all am an and any are aren't as at be
    because been before being below between both but by can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for
    from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've
    if in into is isn't it it's its itself let's me more most mustn't my myself
    no nor not of off on once only or other ought our ours ourselves out over
    own same shan't she she'd she'll she's should shouldn't so some such than
    that that's the their theirs them themselves then there there's these they
    they'd they'll they're they've this those through to too under until up
    very was wasn't we we'd we'll we're we've were weren't what what's when
    when's where where's which while who who's whom why why's with won't would
    wouldn't you you'd you'll you're you've your yours yourself yourselves
    b c d e f g h i j k l m n o p q r s t u v w x y z re ve ll
    """.split()
)
# Characters removed from both ends before punctuation is replaced: U+0000-U+0020.
TRIM_CHARS = "".join(map(chr, range(0x21)))
# Runs of punctuation, symbols, numbers and ASCII white space become one space.
SEPARATOR_RUN = r"[\p{P}\p{S}\p{N} \t\n\x0B\f\r]+"
# ----------------------------------------------------------------------------


def normalize_text(text: Column) -> Column:
    """Lower-case, trim, and turn every separator run into one space.

    The trim comes first, so punctuation at either end still leaves a space.
    """
    return F.regexp_replace(F.btrim(F.lower(text), F.lit(TRIM_CHARS)), SEPARATOR_RUN, " ")


def tokenize_raw(text: Column) -> Column:
    """Every token of the text, as an array.

    A leading separator leaves an empty first token, a trailing one leaves
    nothing, and the empty text is one empty token. NULL text has no tokens.
    """
    norm = normalize_text(text)
    return (
        F.when(norm.isNull() | (norm == " "), F.array().cast("array<string>"))
        .otherwise(F.split(F.rtrim(norm), " "))
    )


def tokenize_filtered(text: Column, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """Tokens longer than one UTF-16 unit that are not stop words."""
    words = sorted(stopwords)

    def keep(token: Column) -> Column:
        # a single character outside the basic plane takes four UTF-8 bytes
        # and counts as two UTF-16 units
        long_enough = (F.length(token) > 1) | (F.octet_length(token) > 3)
        return long_enough & ~token.isin(words) if words else long_enough

    return F.coalesce(
        F.filter(F.split(normalize_text(text), " "), keep),
        F.array().cast("array<string>"),
    )


def with_bag(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """Columns ``keep`` plus the row's ``len`` and bag of words, ``terms`` and ``counts``.

    The tokens of a row are sorted and run-length encoded within the row, so a
    document's term counts never need a shuffle. No lambda refers to another
    array, so a predicate that the optimizer pushes below these projections
    costs at most a second evaluation, never one per element.
    """
    no_token = F.lit(None).cast("string")
    placed = F.transform(
        "_tokens", lambda t, pos: F.struct(t.alias("token"), pos.alias("start"))
    )
    run_starts = F.filter(
        F.zip_with(
            placed,
            F.concat(F.array(no_token), F.col("_tokens")),
            lambda here, before: F.when(~here["token"].eqNullSafe(before), here),
        ),
        lambda here: here["token"].isNotNull(),
    )
    starts = F.col("_runs.start")
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array("_size"))
    return (
        df.select(*keep, F.sort_array(tokens).alias("_tokens"))
        .select(*keep, F.size("_tokens").alias("_size"), run_starts.alias("_runs"))
        .select(
            *keep,
            F.col("_size").cast("bigint").alias("len"),
            F.col("_runs.token").alias("terms"),
            F.when(F.col("_size") == 0, F.array().cast("array<bigint>"))
            .otherwise(F.zip_with(starts, ends, lambda a, b: (b - a).cast("bigint")))
            .alias("counts"),
        )
    )
