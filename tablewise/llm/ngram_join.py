"""Similarity join on word shingles: pairs of documents with a Jaccard similarity of at least 3/4.

1. Texts with equal shingle sets are one class, named by a digest of the set.
2. Each class lists the prefix of its set in one global order, the shingles of very many documents last. Two
   sets that are similar enough share a shingle of their prefixes, so the classes listed under one shingle are
   the only candidates.
3. The classes under a shingle are compared with one hub among them, the class whose shingles are shared most (the
   original of a group of copies, if there is one); then, where they do not all fall into one component, with each
   other in tiles of classes of like size.
4. A comparison first bounds the overlap from above by the bit counts of two hashed bitmaps, and only if that
   leaves a chance counts the intersection of the two sorted sets.

Only pairs within a component that other links already join are never looked at: components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import claim_worker, free_names, rows_of, small, text_digest, with_text
from tablewise.llm.components import connected_components
from tablewise.llm.grams import mix, shingles, word_hashes
from tablewise.sources.staging import stage

SHINGLE_WORDS = 5
#: Jaccard similarity as a fraction; the overlap of sets of a and b elements must be UP / (UP + DOWN) of a + b.
UP, DOWN = 3, 4
#: A shingle is frequent if so many documents have it; the most frequent are used. Frequent shingles come last in the
#: order and are salted; which shingles are found frequent changes the work, not the result.
FREQUENT_DOCS, MOST_FREQUENT = 32, 2_000_000
COUNTED_TOGETHER, COUNTED_LEAST = 2_000_000, 2   # shingles of a task counted at once; least count that is passed on
SALTS = 64
TILE = 512
TILE_FOLDS = 1      # a tile compares bitmaps folded so often: they tell unrelated sets apart, and travel with each row

PROFILE = "doc_id bigint, n bigint, node bigint, bits binary, token bigint, df bigint"


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words in lower case as to A-Z."""
    words, first = word_hashes(column, lower=True)
    grams, first = shingles(words, first, SHINGLE_WORDS)
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:])]


def class_of(members: np.ndarray) -> int:
    """A 64-bit name of a set. Two different sets of a corpus of n share it with a chance of n * n / 2^65."""
    import xxhash

    return xxhash.xxh3_64_intdigest(members.tobytes(), seed=len(members)) - (1 << 63)


def bitmap(members: np.ndarray) -> np.ndarray:
    """Hashed bitmap of 64-bit words, four to eight times as many bits as members; halves can be folded."""
    width = 1 << max(6, int(4 * len(members) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(mix(members) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def may_link(n: int, bits: np.ndarray, others: np.ndarray, other_bits: np.ndarray) -> np.ndarray:
    """Whether the overlap of a set with others (sizes, folded bitmaps as rows) can be large enough. Each bit that
    only one side has is a member that the other side misses."""
    bound = np.minimum(n - np.bitwise_count(bits & ~other_bits).sum(1, dtype=np.int64),
                       others - np.bitwise_count(other_bits & ~bits).sum(1, dtype=np.int64))
    return (UP + DOWN) * bound >= UP * (n + others)


def sizes_allow(a: int, b: int) -> bool:
    return DOWN * min(a, b) >= UP * max(a, b)


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and (token, df) rows of shingles that several documents of a task share."""
    claim_worker("ngram_join")
    names = [c.split()[0] for c in PROFILE.split(", ")]
    seen: set[int] = set()
    waiting: list[np.ndarray] = []
    count = 0

    def shared() -> pa.RecordBatch:
        token, df = np.unique(np.concatenate(waiting), return_counts=True)
        keep = df >= COUNTED_LEAST
        token, df = token[keep], df[keep]
        none = pa.nulls(len(token), pa.int64())
        return pa.record_batch([none, none, none, pa.nulls(len(token), pa.binary()), _int64(token), _int64(df)],
                               names=names)

    for rows in rows_of(batches):
        sets = sets_of(rows.column("text"))
        nodes = [class_of(s) if len(s) else None for s in sets]
        none = pa.nulls(len(sets), pa.int64())
        bits = [bitmap(s).tobytes() if len(s) else None for s in sets]
        yield pa.record_batch([rows.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()),
                               pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), none, none], names=names)
        for s, node in zip(sets, nodes):
            if node is not None and node not in seen:
                seen.add(node)
                waiting.append(s)
                count += len(s)
        if count > COUNTED_TOGETHER:
            yield shared()
            seen, waiting, count = set(), [], 0
    if waiting:
        yield shared()


def prefix(members: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, which are frequent): the first of the set in the global order, one more than a partner can miss."""
    size = len(members) - -(-UP * len(members) // DOWN) + 1
    hot = np.zeros(len(members), bool)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] == members
    order = np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot)])[:size]
    return members[order], hot[order]


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    claim_worker("ngram_join")
    seen: set[int] = set()      # a class once for each task, as far as memory goes
    for rows in rows_of(batches):
        tokens, hots, nodes = [], [], []
        if len(seen) > 1_000_000:
            seen = set()
        for s in sets_of(rows.column("text")):
            if len(s) and (node := class_of(s)) not in seen:
                seen.add(node)
                token, hot = prefix(s, frequent.value)
                tokens.append(token)
                hots.append(hot)
                nodes.append(np.full(len(token), node, np.int64))
        if tokens:
            yield pa.record_batch([_int64(np.concatenate(tokens)), _int64(np.concatenate(nodes)),
                                   pa.array(np.concatenate(hots))], names=["token", "node", "hot"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with (n, bits) of both sides -> the pairs that sizes and bit counts leave."""
    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in ("a", "b", "na", "nb", "bits_a", "bits_b")]
        kept = []
        for a, b, na, nb, x, y in zip(*columns):
            if sizes_allow(na, nb):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                if may_link(na, folded(x, words), np.array([nb]), folded(y, words)[None])[0]:
                    kept.append((a, b))
        yield _pairs(kept)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim_worker("ngram_join")
    for rows in rows_of(batches):
        sets = [s for s in sets_of(rows.column("text")) if len(s)]
        yield pa.record_batch([pa.array([class_of(s) for s in sets], pa.int64()),
                               pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sorted sets -> the pairs that are similar enough."""
    for rows in batches:
        kept = []
        for a, b, x, y in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "members_a", "members_b"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if DOWN * both >= UP * (len(x) + len(y) - both):
                kept.append((a, b))
        yield _pairs(kept)


def _tile(rows: pa.Table) -> pa.Table:
    """The pairs of a tile that sizes and bit counts leave. Left out: pairs of one component, and those with the
    hub of the shingle, which are compared already. ``side`` 0 are the rows and columns of a tile on the
    diagonal, or its rows; side 1 its columns."""
    rows = rows.sort_by([("n", "ascending"), ("node", "ascending")])
    node, n, root, hub, side = (rows.column(c).to_numpy() for c in ("node", "n", "root", "hub", "side"))
    bits = [np.frombuffer(b, np.uint64) for b in rows.column("bits").to_pylist()]
    width = np.array([len(b) for b in bits])
    square = not side.any()
    at_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    kept = []
    for i in range(len(node)):
        w = int(width[i])
        if w not in at_width:       # larger sets within the size limit have as wide a bitmap, or twice as wide
            among = np.flatnonzero((width == w) | (width == 2 * w))
            at_width[w] = among, np.stack([folded(bits[j], w) for j in among])
        among, matrix = at_width[w]
        near = (among > i) & (DOWN * n[i] >= UP * n[among]) & (root[among] != root[i])
        near &= (hub[among] != node[i]) & (node[among] != hub[i])
        if not square:
            near &= side[among] != side[i]
        if near.any():
            j = among[near]
            j = j[may_link(int(n[i]), bits[i], n[j], matrix[near])]
            kept += [(min(node[i], node[k]), max(node[i], node[k])) for k in j]
    return pa.Table.from_batches([_pairs([(int(a), int(b)) for a, b in kept])])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        bits = [np.frombuffer(b, np.uint64) for b in rows.column("bits").to_pylist()]
        bits = [folded(b, max(1, len(b) >> TILE_FOLDS)).tobytes() for b in bits]
        yield pa.record_batch([rows.column("node"), rows.column("n"), pa.array(bits, pa.binary())],
                              names=["node", "n", "bits"])


class ShingleJoin:
    """The steps of the join over a table of documents (doc_id, text), each written to the shared folder."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.profile = stage(docs.mapInArrow(_profile, PROFILE), "shingle-profile")
        self.of_docs = self.profile.where("token is null").drop("token", "df", "bits")

    def frequent(self) -> np.ndarray:
        """The frequent shingles, at most MOST_FREQUENT of them: 16 MB."""
        shared = self.profile.where("token is not null").groupBy("token").agg(F.sum("df").alias("df"))
        found = shared.where(F.col("df") >= FREQUENT_DOCS).orderBy(F.desc("df"), "token").limit(MOST_FREQUENT)
        return np.sort(found.select("token").toArrow().column(0).to_numpy().view(np.uint64))

    def members(self) -> DataFrame:
        """(token, node) of the shingles that two classes or more list. The shingles known as frequent are salted."""
        frequent = self.docs.sparkSession.sparkContext.broadcast(self.frequent())
        listed = self.docs.mapInArrow(partial(_prefixes, frequent=frequent), "token bigint, node bigint, hot boolean")
        salt = F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(-1))
        group = Window.partitionBy("token", "salt")
        gathered = listed.withColumn("salt", salt).withColumns({
            "low": F.min("node").over(group), "high": F.max("node").over(group)})
        return stage(gathered.where(F.col("hot") | (F.col("low") < F.col("high"))).select("token", "node"),
                     "shingle-members")

    def with_hubs(self, members: DataFrame, signatures: DataFrame) -> DataFrame:
        """(token, node, hub, size): the hub of a shingle is the class with the largest share of shared shingles.
        Counts and maxima are taken before the shuffle as well, whatever the size of a group."""
        shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
        score = stage(shared.join(signatures.select("node", "n"), "node").select(
            "node", (F.col("shared") / F.col("n")).alias("score")), "shingle-scores")
        hubs = members.join(small(score), "node").groupBy("token").agg(
            F.max_by("node", "score").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
        return stage(members.join(hubs, "token"), "shingle-hubs")

    def stars(self, members: DataFrame) -> DataFrame:
        """Pairs with the hub of each shingle."""
        return members.where("node <> hub").select(
            F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()

    def signatures(self, members: DataFrame) -> DataFrame:
        """(node, doc_id, n, bits) of the classes that are candidates, with the least document of each."""
        wanted = members.select("node").distinct()
        found = self.profile.where("token is null and doc_id is not null").join(wanted, "node", "left_semi")
        return stage(found.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                               F.first("bits").alias("bits")), "shingle-signatures")

    def verify(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        """The pairs that pass the bit counts already, by exact intersection."""
        pairs = stage(pairs, "shingle-pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = stage(signatures.join(nodes, "node", "left_semi").select("doc_id").distinct(), "shingle-ids")
        sets = stage(self.docs.join(small(ids), "doc_id", "left_semi").mapInArrow(_sets, "node bigint, members binary")
                     .dropDuplicates(["node"]), "shingle-sets")
        side = {s: sets.select(F.col("node").alias(s), F.col("members").alias(f"members_{s}")) for s in "ab"}
        return stage(pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "members_a", "members_b")
                     .mapInArrow(_linked, "a bigint, b bigint"), "shingle-links")

    def bounded(self, pairs: DataFrame, signatures: DataFrame) -> DataFrame:
        side = {s: signatures.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}"))
                for s in "ab"}
        both = pairs.join(side["a"], "a").join(side["b"], "b")
        allowed = F.lit(DOWN) * F.least("na", "nb") >= F.lit(UP) * F.greatest("na", "nb")
        return both.where(allowed).select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(
            _bounded, "a bigint, b bigint")

    def rest(self, members: DataFrame, signatures: DataFrame, roots: DataFrame) -> DataFrame:
        """Candidate pairs of different components under shingles that the stars did not settle, in tiles: the classes
        of a hub in one, or, if they are many, by size bands and parts of these, each with itself and the next band."""
        # Shingles with one hub are settled together: their classes are mostly the same, and a pair comes out once.
        several = members.where("size > 2").select("hub", "node").distinct()
        root = F.coalesce("root", "node").alias("root")
        placed = stage(several.join(small(roots), "node", "left").select("hub", "node", root), "shingle-placed")
        open_ = stage(placed.groupBy("hub").agg(
            F.count(F.lit(1)).alias("all"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low < high").select("hub", "all"), "shingle-open")
        # Bitmaps come last: the places of a class are found from its size, in rows of a few numbers.
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DOWN / UP))).cast("int").alias("band")
        rows = stage(placed.join(open_, "hub").join(signatures.select("node", "n"), "node").select(
            "hub", "node", "root", "all", band), "shingle-open-classes")
        tiles = stage(rows.where(F.col("all") > TILE).groupBy("hub", "band").agg(
            F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "shingle-bands")
        # the tiles of a band and of those above and below, from one row for each of the three
        bands = tiles.select("hub", "tiles", F.inline(F.array(*[
            F.struct((F.col("band") + step).alias("band"), F.lit(name).alias("of"))
            for step, name in ((0, "tiles"), (-1, "above"), (1, "below"))])))
        bands = stage(bands.groupBy("hub", "band").agg(*[
            F.max(F.when(F.col("of") == name, F.col("tiles"))).alias(name) for name in ("tiles", "above", "below")])
            .where("tiles is not null"), "shingle-tiles")

        def places(last: str, row: str, column: str, side: str, next_: int, band: str = "band") -> str:
            place = f"named_struct('band', {band}, 'row', {row}, 'column', {column}, 'side', {side}, 'next', {next_})"
            return f"if({last} is null, array(), transform(sequence(0, {last} - 1), i -> {place}))"

        own = places("tiles", "least(i, tile)", "greatest(i, tile)", "if(tile > i, 1, 0)", 0)
        up = places("above", "tile", "i", "0", 1)
        down = places("below", "i", "tile", "1", 1, "band - 1")
        whole = "array(named_struct('band', 0, 'row', 0, 'column', 0, 'side', 0, 'next', 0))"
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        placed = rows.join(bands, ["hub", "band"], "left").withColumn("tile", tile).selectExpr(
            "hub", "node", "root", f"inline(if(tiles is null, {whole}, concat({own}, {up}, {down})))")
        with_bits = stage(signatures.select("node", "n", "bits").mapInArrow(
            _folded, "node bigint, n bigint, bits binary"), "shingle-tile-bits")
        laid = placed.join(with_bits, "node").select(
            "hub", "band", "row", "column", "side", "next", "node", "root", "n", "bits")
        key = ["hub", "band", "row", "column", "next"]

        def compared(rows: pa.Table) -> pa.Table:
            return _tile(rows)

        return laid.groupBy(*key).applyInArrow(compared, "a bigint, b bigint").distinct()


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the size of its set of distinct 5-word shingles, and
    the least doc_id that links of Jaccard similarity 3/4 or more reach.

    Words are what ASCII white space separates, A-Z in lower case. A text of fewer words is one shingle; without
    words it has none and links with nothing. Equal sets are one class and are compared once, however many copies
    there are; a task lists a class once. No pair is dropped: candidates are every two classes that share a
    shingle of their prefixes, and only pairs that a component already holds are skipped.

    Defined results: a missing text is empty; repeated rows are copies; a row without doc_id keeps its own
    size, takes no part and has no component; an empty table gives no rows.
    """
    join = ShingleJoin(with_text(df, id_col, text_col))
    members = join.members()
    signatures = join.signatures(members)
    members = join.with_hubs(members, signatures)
    links = join.verify(join.bounded(join.stars(members), signatures), signatures)
    roots = stage(connected_components(links), "shingle-roots")
    more = join.verify(join.bounded(stage(join.rest(members, signatures, roots), "shingle-tile-pairs"), signatures),
                       signatures)
    if not more.isEmpty():      # the components so far are links themselves
        roots = stage(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)),
                      "shingle-roots")

    named = join.of_docs.where("node is not null and doc_id is not null").join(roots, "node", "left").select(
        "doc_id", "n", F.coalesce("root", "node").alias("root"))
    # written first, so that Spark can split the rows of a large component when it joins them
    least = stage(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "shingle-component-ids")
    linked = named.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = join.of_docs.where("node is null or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, less those that links join to a document of a lower id; of equal rows
    (id and text) one stays. Different texts are joined by what they say, also where they share an id: of linked texts of
    one id that of the lower digest stays. Documents without id or without words stay."""
    id_name, digest = free_names(df, "dropped_id", "dropped_digest")
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"),
                                                      F.col(text_col).alias("text"))
    kinds = stage(ngram_join(docs, "digest", "text").where("n_shingles > 0").groupBy(F.col("doc_id").alias("digest")).agg(
        F.min("component_id").alias("kind")), "shingle-kinds")
    rows = stage(docs.select("id", "digest").join(small(kinds), "digest").groupBy("kind", "id", "digest").agg(
        F.count(F.lit(1)).alias("n")), "shingle-documents")
    least = stage(rows.groupBy("kind").agg(F.min(F.struct("id", "digest")).alias("least")), "shingle-least")
    stays = (F.col("id") == F.col("least.id")) & (F.col("digest") == F.col("least.digest"))
    judged = rows.join(small(least), "kind")
    dropped = stage(judged.where(~stays).select("id", "digest"), "shingle-dropped").toDF(id_name, digest)
    repeated = stage(judged.where(stays & (F.col("n") > 1)).select("id", "digest"), "shingle-repeated").toDF(id_name, digest)
    same = (df[id_col] == F.col(id_name)) & (text_digest(text_col) == F.col(digest))
    kept = df.join(small(dropped), same, "left_anti")
    if repeated.isEmpty():
        return kept
    again = (kept[id_col] == F.col(id_name)) & (text_digest(text_col) == F.col(digest))
    once = kept.join(repeated, again, "left_semi").withColumn(digest, text_digest(text_col))
    return kept.join(repeated, again, "left_anti").unionByName(once.dropDuplicates([id_col, digest]).drop(digest))
