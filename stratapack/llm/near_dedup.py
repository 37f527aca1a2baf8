"""MinHash near-dedup by an inverted join over signature coordinates.

1. A text's set of 5-word shingles gives a key (its 64-bit set hash) and a signature of K coordinates.  Texts with
   equal sets are one node from here on.
2. Nodes are posted under each (coordinate, value).  Two sets of similarity s agree in about K * s coordinates; pairs with fewer
   than MATCHES agreements are not wanted.  With postings ordered by length, two nodes that agree MATCHES times
   share one of their K - MATCHES + 1 shortest ones (prefix), so each node skips its MATCHES - 1 longest, which is where
   common passages and large groups stand.  Postings of one node are never joined.
3. In short postings all pairs are candidates.  In long ones each node is paired with the posting's leader only, and the links
   so found are merged.  Pairs within a component are skipped.  For the nodes of long postings that still hold several components the pairs across
   are found by rest_pairs(), a prefix join over their full sets.  So a large group of copies costs about one pair a node, and no
   link between components is lost.
4. A candidate's agreements are counted over the whole signatures; those with MATCHES or more are confirmed on full sets:
   100 * intersection >= 75 * union.
5. Components are found by minimum labels with pointer jumping, in Spark.

A pair at similarity 0.75 exactly agrees in 48 +- 3.5 of 64 coordinates, so it falls below 32 about twice in a million.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, Words, chunks, cut, distinct_per_text, free_name, mix, shingles, table, text_buffers

K, MATCHES = 64, 32
#: Postings of up to so many nodes give all their pairs at once.
SHORT = 12
#: A posting's members are dealt to parts of about so many.
SHARE = 1000
#: Node lists of up to so many bytes are broadcast, larger ones joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_A = np.random.Generator(np.random.PCG64(75)).integers(1, 1 << 63, K, dtype=np.uint64) * U64(2) + U64(1)
_B = np.random.Generator(np.random.PCG64(76)).integers(0, 1 << 63, K, dtype=np.uint64)


def _sets(chunk: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, their ranges, set hash) of each text."""
    h, first = distinct_per_text(*shingles(Words(*text_buffers(chunk.column(text)))))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
        key = mix((total[first[1:]] - total[first[:-1]]) ^ (np.diff(first).astype(np.uint64) << U64(40)))
    return h, first, key.view(np.int64)


def _signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """K minimum values of 31 bits for each text that has shingles."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), K), np.int32)
    with np.errstate(over="ignore"):
        for k in range(K if len(at) else 0):
            out[:, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> U64(33)).astype(np.int32), at)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n_shingles, node, signature); without words node and signature are null."""

    def scan(batches):
        for batch in batches:
            for chunk in chunks(batch, "text"):
                h, first, key = _sets(chunk, "text")
                size = np.diff(first)
                offsets = np.concatenate([[0], np.cumsum((size > 0) * K)]).astype(np.int32)
                sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signatures(h, first).ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(size, pa.int64()), pa.array(key, mask=size == 0), sig], names=["id", "n_shingles", "node", "signature"])

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "id bigint, n_shingles bigint, node bigint, signature array<int>")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def prefixes(nodes: DataFrame) -> DataFrame:
    """(node, size, token, m, leader, leader_size): the postings in each node's prefix that others share, with their length and leader.

    A leader is the member whose tokens are the most common ones: of a group of copies of one text that is the text itself
    or what is nearest to it, so most of the group links with it directly.
    """
    posts = nodes.select("node", "size", F.posexplode("signature")).select("node", "size", (F.col("pos").cast("bigint") * F.lit(1 << 32) + F.col("col")).alias("token"))
    stats = posts.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    own = posts.join(stats, "token").groupBy("node", "size").agg(F.collect_list(F.struct("n", "token")).alias("t"), F.sum(F.log("n")).alias("score"))  # K at most
    own = own.where(F.size("t") >= MATCHES).withColumn("t", F.slice(F.sort_array("t"), F.lit(1), F.size("t") - (MATCHES - 1)))
    prefix = cut(own.select("node", "size", "score", F.explode("t").alias("t")).select("node", "size", "score", "t.token", F.ceil(F.col("t.n") / SHARE).cast("int").alias("parts")))  # written, so that lengths and leaders don't make it again
    lead = prefix.groupBy("token", "parts").agg(F.count("*").alias("m"), F.max(F.struct("score", "node", "size")).alias("l")).where("m > 1")
    lead = lead.select("token", "m", F.col("l.node").alias("leader"), F.col("l.size").alias("leader_size"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = prefix.withColumn("part", F.pmod(F.col("node"), F.col("parts")).cast("int"))  # the members of a long posting meet its leader in several parts
    return dealt.join(lead, ["token", "part"]).select("node", "size", "token", "m", "leader", "leader_size")


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def rest_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes with different labels whose full sets can be similar enough.

    `sets` is (node, shingles); labels is (node, label).  The exact way for long postings: shingles are ordered by how many of these nodes
    have them.  Sets of sizes x and y that are similar enough share o = percent * (x + y) / (100 + percent) shingles or more, so the first one that they share
    stands where o - 1 more can follow in both.  What only one copy has comes first and is never joined.
    """

    def spread(batches):
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
            size = np.array([len(x) for x in parts])
            yield pa.record_batch([pa.array(np.repeat(batch.column("node").to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(parts))], names=["node", "size", "s"])

    every = sets.mapInArrow(spread, "node bigint, size bigint, s bigint")
    shared = every.join(every.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "s")
    own = shared.groupBy("node", "size").agg(F.collect_list(F.struct("n", "s")).alias("t"))  # one text's shingles
    alone = (F.col("size") - F.size("t")).cast("int")
    reach = (F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).cast("int") - alone
    own = own.select("node", "size", alone.alias("alone"), F.slice(F.sort_array("t"), F.lit(1), F.greatest(reach, F.lit(0))).alias("t")).join(labels, "node")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("t.s", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))))
    x = own.where(F.size("t") > 0).select("node", "size", "label", "alone", F.posexplode(F.arrays_zip(F.col("t.s").alias("s"), before.alias("before"))).alias("pos", "z"))
    x = x.select(F.col("z.s").alias("s"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("label").alias("la"), (F.col("size") - F.col("alone") - F.col("pos")).alias("fa"), F.col("z.before").alias("ba"))
    y = x.toDF("s", "b", "nb", "lb", "fb", "bb")
    # where both have the same shingle before this one, the pair was found there already
    again = F.coalesce(F.col("ba") == F.col("bb"), F.lit(False))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    follow = F.least("fa", "fb") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))
    return x.join(y, "s").where(ordered & ~again & (F.col("la") != F.col("lb")) & _sizes_fit("na", "nb", percent) & follow).select(*_ordered("a", "b")).distinct()


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that agree in MATCHES coordinates or more."""
    sig = nodes.select("node", "signature")
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return both.where(same >= MATCHES).select("a", "b")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, rep), from the text of the document `rep`, or of those without id where `rep` is null."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).cast("string").alias("text"))
    nameless = own.where("rep is null") if wanted.where("rep is null").limit(1).count() else None
    few = wanted.where("rep is not null").select("rep").distinct()
    if few.count() * 16 <= BROADCAST_BYTES:
        few = F.broadcast(few)
    own = own.join(few, "rep", "left_semi")
    if nameless is not None:
        own = own.union(nameless)

    def scan(batches):
        for batch in batches:
            for chunk in chunks(batch, "text"):
                h, first, key = _sets(chunk, "text")
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    made = own.select("text").mapInArrow(scan, "node bigint, shingles binary")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def scan(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(scan, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge is connected with.

    Labels fall to the smallest label among the neighbours, then jump to their label's label; each round is cut.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = cut(labels)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        fell = labels.join(near, "node").select("node", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        jump = fell.join(labels.select(F.col("node").alias("low"), F.col("label").alias("further")), "low", "left")
        new = cut(jump.select("node", F.least("low", F.coalesce("further", "low")).alias("label"), "old"))
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of `docs`.

    Words are lower-cased (A-Z); fewer than five words are one shingle.  Null and empty texts have no shingles and
    are linked with nothing: they are their own component.  Very long texts give whole sets.  component_id is the smallest id of the component and kept whether it is the row's own.  Rows of
    equal id are separate texts under one id.  A row without id links others but can't name a component; its kept is true only if
    its component has no id at all, and component_id is null then.  An empty table gives an empty table.
    """
    return node_components(docs, doc_id, text, percent).drop("node")


def node_components(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """near_components(), and each row's node: the hash of its set, null without shingles."""
    rows = cut(signatures(docs, doc_id, text))
    nodes = cut(rows.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("signature").alias("signature")))
    posts = cut(prefixes(nodes))

    stars = posts.where((F.col("leader") != F.col("node")) & _sizes_fit("size", "leader_size", percent)).select(*_ordered("leader", "node"))
    short = posts.where(F.col("m") <= SHORT).select("token", "node", "size")
    pairs = short.join(short.toDF("token", "other", "size2"), "token").where((F.col("node") < F.col("other")) & _sizes_fit("size", "size2", percent)).select(F.col("node").alias("a"), F.col("other").alias("b"))
    edges = _links(docs, doc_id, text, nodes, cut(agreeing(stars.union(pairs).distinct(), nodes)), percent)
    labels = components(edges)

    # what is left: pairs across components in long postings
    long = posts.where(F.col("m") > SHORT).select("token", "node").join(labels, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = long.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    rest = cut(long.join(mixed, "token", "left_semi").select("node", "label").distinct())
    if rest.limit(1).count():
        wanted = cut(nodes.select("node", "rep").join(rest, "node", "left_semi"))
        sets = cut(full_sets(docs, wanted, doc_id, text))
        more = cut(confirm(agreeing(rest_pairs(sets, rest, percent), nodes), sets, percent))
        if more.limit(1).count():
            labels = components(edges.union(more))

    named = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_node = named.join(smallest, "label").select("node", "component_id")
    out = rows.select("id", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"), "node")


def _links(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.select("node", "rep").join(ends, "node", "left_semi"))
    return cut(confirm(pairs, full_sets(docs, wanted, doc_id, text), percent))


def _few(frame: DataFrame, width: int) -> DataFrame:
    """Broadcast if it is measured to be small."""
    return F.broadcast(frame) if frame.count() * width <= BROADCAST_BYTES else frame


def with_node(docs: DataFrame, text: str, to: str) -> DataFrame:
    """`docs` with the node of each row's text in column `to`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.LongType())])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in batches:
            for chunk in chunks(batch, text):
                _, first, key = _sets(chunk, text)
                yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(key, mask=np.diff(first) == 0)], schema=arrow)

    return docs.mapInArrow(scan, schema)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of `docs` that stay: of each component the rows with its smallest id, and all rows without id.

    Rows of equal id are judged each by its own text, and equal rows alike.  What near_components() says of null, empty and long texts holds.
    No column of `docs` is changed.
    """
    verdicts = cut(node_components(docs, doc_id, text, percent).where("id is not null"))
    by_id = verdicts.groupBy("id").agg(F.max("kept").alias("some"), F.min("kept").alias("all")).where("not all")
    key, node = free_name("id", docs.columns), free_name("node", docs.columns)
    by_id = cut(by_id.select(F.col("id").alias(key), "some"))
    gone = _few(by_id.where("not some").drop("some"), 16)
    same = lambda other: F.col(f"`{doc_id}`").cast("bigint") == other[key]
    left = docs.join(gone, same(gone), "left_anti")
    # ids of which some rows stay and others go: their rows are told apart by their texts
    mixed = by_id.where("some").drop("some")
    if mixed.limit(1).count():
        mixed = _few(mixed, 16)
        ends = verdicts.where("not kept").select(F.col("id").alias(key), F.col("node").alias(f"{node}_gone")).distinct()
        rows = with_node(left.join(mixed, same(mixed), "left_semi"), text, node)
        rows = rows.join(ends, same(ends) & F.col(node).eqNullSafe(ends[f"{node}_gone"]), "left_anti").drop(node)
        left = left.join(mixed, same(mixed), "left_anti").union(rows)
    return left


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), low AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id, least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON a = d.doc_id
"""
