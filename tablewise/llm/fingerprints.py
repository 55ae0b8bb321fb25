"""Document fingerprints by winnowing, in DataFrame functions only.

A text is cut into short tokens, every run of ``GRAM`` tokens is hashed, and of every ``WINDOW`` hashes in a row the
least is kept with its place, the rightmost of equals. Two texts that share a run of GRAM + WINDOW - 1 tokens
share a kept hash.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import with_text

#: Tokens: up to four letters or digits, from the start of a word on, or one other character but white space
TOKEN = r"[\p{L}\p{N}]{1,4}|[^\p{L}\p{N}\s]"
GRAM, WINDOW = 3, 4
#: A key is a hash above and a place below, counted down so that the rightmost of equal hashes is the least
PLACE_BITS = 29
LAST_PLACE = (1 << PLACE_BITS) - 1

#: Documents in order are dealt into buckets of about so many, as far as the bounds fit into an expression
BUCKET_DOCS, MOST_BUCKETS = 64, 4096


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """The table with the column ``name``: the kept keys of the text, in order of their places.

    Each step is a column of its own, as the next one looks at it many times."""
    tokens, keys = f"{name}_tokens", f"{name}_keys"

    def gram(token: Column, i: Column) -> Column:
        value = F.xxhash64(token, *[F.get(F.col(tokens), i + j) for j in range(1, GRAM)])
        place = F.lit(LAST_PLACE) - F.least(i, F.lit(LAST_PLACE))
        return F.shiftleft(F.shiftright(value, PLACE_BITS), PLACE_BITS).bitwiseOR(place)

    def least(key: Column, i: Column) -> Column:
        return F.least(key, *[F.get(F.col(keys), i + j) for j in range(1, WINDOW)])

    def runs(array: str, size: int) -> Column:
        """How many runs of ``size`` an array has; a shorter one is a run itself."""
        return F.greatest(F.size(array) - (size - 1), F.least(F.size(array), F.lit(1)))

    return (df.withColumn(tokens, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
            .withColumn(keys, F.slice(F.transform(tokens, gram), F.lit(1), runs(tokens, GRAM))).drop(tokens)
            .withColumn(name, F.array_distinct(F.slice(F.transform(keys, least), F.lit(1), runs(keys, WINDOW))))
            .drop(keys))


def places(keys: Column | str) -> Column:
    """The token places of the kept hashes."""
    keys = F.col(keys) if isinstance(keys, str) else keys
    return F.transform(keys, lambda k: F.lit(LAST_PLACE) - k.bitwiseAND(F.lit(LAST_PLACE)))


def hashes(keys: Column | str) -> Column:
    """The distinct kept hashes."""
    keys = F.col(keys) if isinstance(keys, str) else keys
    return F.array_distinct(F.transform(keys, lambda k: F.shiftright(k, PLACE_BITS)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two columns of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def digest(keys: str) -> Column:
    """A short text that is equal for equal fingerprints: their number and a hash of all keys with places."""
    return F.concat(F.size(keys).cast("string"), F.lit("-"), F.lower(F.lpad(F.hex(F.xxhash64(keys)), 16, "0")))


def in_order_buckets(docs: DataFrame, order: str) -> tuple[DataFrame, int]:
    """The table with a ``bucket`` that ascends with the column ``order``, and its rows.

    The bounds are approximate quantiles of all values, at most ``MOST_BUCKETS``; a value finds its bucket among the
    coarse bounds and then among the fine ones of that stretch."""
    rows = docs.count()
    buckets = max(1, min(MOST_BUCKETS, rows // BUCKET_DOCS))
    shares = [i / buckets for i in range(1, buckets)]
    found = docs.select(F.percentile_approx(order, shares or [0.5], 100 * MOST_BUCKETS)).first()[0] if rows else []
    bounds = sorted(set(found or []))
    step = max(1, isqrt(len(bounds)))
    stretches = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[0]]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= F.col(order)))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    coarse = F.greatest(F.lit(1), below(longs([s[0] for s in stretches])))
    fine = below(F.element_at(F.array(*[longs(s) for s in stretches]), coarse))
    return docs.withColumn("bucket", coarse * (step + 1) + fine), rows


def with_next(docs: DataFrame, more: list[str]) -> DataFrame:
    """(doc_id, text, ...) with next_text: the text of the next document by ascending doc_id, after the last
    that of the first. ``more`` names columns that ``with_fingerprint`` adds, of which the next one's come as well.

    Buckets of neighbours are sorted each on its own, with the first document behind a bucket added to it, so that a
    text moves once and no task sorts all documents. Missing ids come first, equal ids by a hash of the text."""
    keyed = docs.withColumns({"place": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    dealt, _ = in_order_buckets(keyed, "place")
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min("place")).collect())
    behind = [(b, first) for (b, _), (_, first) in zip(firsts, [*firsts[1:], *firsts[:1]])]
    starts = docs.sparkSession.createDataFrame(behind, "bucket int, place bigint")     # one row for each bucket
    added = keyed.join(F.broadcast(starts), "place").select(*dealt.columns, F.lit(1).alias("behind"))
    laid = dealt.withColumn("behind", F.lit(0)).unionByName(added).repartition("bucket")
    for name in more:
        laid = with_fingerprint(laid, "text", name)
    order = Window.partitionBy("bucket").orderBy("behind", "place", "tie")
    found = laid.withColumns({f"next_{c}": F.lead(c).over(order) for c in ["text", *more]})
    return found.where("behind = 0").drop("behind", "place", "tie", "bucket")


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the kept keys of each document; ``hashes`` and ``places`` take them apart.

    Defined results: a missing or empty text, or one without tokens, has no keys; a text below ``GRAM`` tokens is
    one run, one below ``WINDOW`` runs has one window; equal texts have equal keys; an empty table gives no rows.
    """
    return with_fingerprint(with_text(df, id_col, text_col), "text", "fingerprint").drop("text")


def compare_with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last quarter replaced by as many characters, or all, of the next document. Likeness is
    the Jaccard similarity of the kept hashes: 1 for equal texts and for two texts without tokens, 0 if only one has
    any. The next document of the last is the first, of a single one itself; repeated rows follow each other;
    an empty table gives no rows.
    """
    docs = with_next(with_text(df, id_col, text_col), ["fingerprint"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    texts = docs.withColumns({"n_chars": n.cast("bigint"), "edited": edited}).drop("text", "next_text")
    compared = with_fingerprint(texts, "edited", "edited_fingerprint").withColumns({
        "own_hashes": hashes("fingerprint"), "edited_hashes": hashes("edited_fingerprint"),
        "next_hashes": hashes("next_fingerprint")})
    return compared.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                           likeness("own_hashes", "edited_hashes").alias("near_edited"),
                           likeness("own_hashes", "next_hashes").alias("near_next"))
