"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set is its distinct shingles of ``WORDS`` words (64-bit hashes); a
signature has ``COORDS`` MinHash coordinates, each with its number in the top bits.

1. Documents with equal sets form a class; its smallest id stands for it.
2. Each class is posted under its (coordinate, value) pairs.  Pairs posted once
   can't collide.  Two classes with ``MIN_MATCHES`` equal coordinates share one of
   the COORDS - MIN_MATCHES + 1 rarest of either (prefix merging), so only those
   are posted, and a class that has as many unshared coordinates isn't at all.
3. In each posting list the most central member is the hub; the others are compared
   with it, and links confirmed on full sets give first components.
4. In lists that still hold several components, members are compared with those of
   other components, in tiles of bounded size: collisions are counted over the
   signatures, and a pair is skipped in all lists but its first common one, and if
   its ends are connected already.  What stays is confirmed on full sets.
5. Components of all links.  No pair between different components goes untested,
   so skipped pairs never change a component.

A pair at similarity 0.75 has fewer than MIN_MATCHES of 32 equal coordinates with a
probability of about 1e-5, so a link is lost only if that happens on every path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete_shared, maybe_in, slices, table, trimmed, write_shared

WORDS = 5
COORDS = 32
MIN_MATCHES = 13
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members of a list that are compared with each other at once, and with a hub at once.
TILE = 512
CHUNK = 64

_SHIFT = np.uint64(59)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240601)
_MUL = _rng.integers(0, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_NUMBER = np.arange(COORDS, dtype=np.uint64) << _SHIFT


class _WordHashes(dict):
    """Word: 64-bit hash, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of the whole word sequence if
    that is shorter; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * _MIX + h[i : len(h) - n + 1 + i]
    return np.unique(_scrambled(out))


def signature(members: np.ndarray) -> np.ndarray:
    """The coordinates' smallest values, each with the coordinate's number on top."""
    least = np.full(COORDS, 2**64 - 1, np.uint64)
    for at in range(0, len(members), 4096):
        least = np.minimum(least, (members[at : at + 4096, None] * _MUL + _ADD).min(axis=0))
    return (_NUMBER | (_scrambled(least) >> np.uint64(5))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < PERCENT * high:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (low + high - common)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        for part in slices(batch, "text"):
            sizes, digests, tokens = [], [], []
            for text in part.column("text"):
                members = shingle_set(text.as_py(), hashes)
                sizes.append(len(members))
                digests.append(xxhash.xxh3_128_hexdigest(members.tobytes()))
                tokens.append(signature(members) if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(tokens, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "tokens"],
            )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the links (a, b), component being the smallest node: each
    round maps a node to its smallest neighbour's smallest neighbour and contracts."""
    edges = write_shared(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = write_shared(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while edges.take(1):
        both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        parent = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        above = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = write_shared(parent.join(above, "p").select("u", "q"), "jump")
        renamed = labels.join(jump, labels["component"] == jump["u"], "left").select("node", F.coalesce("q", "component").alias("component"))
        new_labels = write_shared(renamed, "labels")
        ends = edges.join(jump.toDF("a", "qa"), "a").join(jump.toDF("b", "qb"), "b")
        new_edges = ends.where("qa <> qb").select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).distinct()
        new_edges = write_shared(new_edges, "edges")
        for old in (edges, labels, jump):
            delete_shared(old)
        edges, labels = new_edges, new_labels
    return labels


def _texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """``keys`` (with column doc) with the text of doc."""
    docs = maybe_in(docs, "doc_id", keys.select("doc"))
    return keys.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")


def _star_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of one hub (the first by ``is_hub``) with a chunk of its fellows."""
    hashes = _WordHashes()
    hub = next((t.as_py() for t, h in zip(rows.column("text"), rows.column("is_hub")) if h.as_py()), None)
    own, found = shingle_set(hub, hashes), []
    for doc, text, is_hub in zip(rows.column("doc"), rows.column("text"), rows.column("is_hub")):
        if not is_hub.as_py() and similar(own, shingle_set(text.as_py(), hashes)):
            found.append(doc.as_py())
    return pa.table({"a": pa.array([key[0].as_py()] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def _matrix(lists: pa.ChunkedArray, lengths: list[int] | None, empty: int) -> np.ndarray:
    """Tokens by coordinate; ``empty`` where a document has none (or none in the prefix)."""
    out = np.full((len(lists), COORDS), empty, np.int64)
    for i, tokens in enumerate(lists):
        t = np.asarray(tokens.as_py()[: None if lengths is None else lengths[i]], np.int64)
        out[i, t.view(np.uint64) >> _SHIFT] = t
    return out


def _pairs_of_tile(key: tuple, rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the tile's left block: the rows of its right block that may be
    linked with it, in another component, and have this list as first common one."""
    token, left, right = (k.as_py() for k in key)
    block, comp, size = (np.asarray(rows.column(c)) for c in ("block", "component", "n_shingles"))
    prefix = rows.column("n_prefix").to_pylist()
    full, also = (_matrix(rows.column("tokens"), None, e) for e in (-1, -2))
    head, head_also = (_matrix(rows.column("tokens"), prefix, e) for e in (-1, -2))
    coordinate = int(np.array([token], np.int64).view(np.uint64)[0] >> _SHIFT)
    others = np.flatnonzero(block == right)
    for i in np.flatnonzero(block == left):
        js = others[others > i] if left == right else others
        js = js[(comp[js] != comp[i]) & (100 * np.minimum(size[js], size[i]) >= PERCENT * np.maximum(size[js], size[i]))]
        js = js[(full[i] == also[js]).sum(axis=1) >= MIN_MATCHES] if len(js) else js
        if len(js):
            yield i, js[(head[i] == head_also[js]).argmax(axis=1) == coordinate]


def _tile_members(key: tuple, rows: pa.Table) -> pa.Table:
    """Rows of the tile that take part in any pair to be confirmed."""
    keep = np.zeros(rows.num_rows, bool)
    for i, js in _pairs_of_tile(key, rows):
        keep[i] |= len(js) > 0
        keep[js] = True
    return rows.filter(pa.array(keep))


def _tile_links(key: tuple, rows: pa.Table) -> pa.Table:
    """Confirmed links of the tile that join different components, each once."""
    hashes = _WordHashes()
    sets = [shingle_set(t.as_py(), hashes) for t in rows.column("text")]
    docs, group, found = rows.column("doc").to_pylist(), {}, []
    comp = rows.column("component").to_pylist()

    def root(x: int) -> int:
        while group.get(x, x) != x:
            group[x] = group.get(group[x], group[x])
            x = group[x]
        return x

    for i, js in _pairs_of_tile(key, rows):
        for j in js.tolist():
            a, b = root(comp[i]), root(comp[j])
            if a != b and similar(sets[i], sets[j]):
                group[max(a, b)] = min(a, b)
                found.append((docs[i], docs[j]))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept) for each row of ``docs``
    (doc_id long, text string; other columns are ignored).

    Null, empty and wordless texts have an empty set and are linked with nothing;
    repeated rows come out as often as they came in; an empty table gives none.  A row
    with a null doc_id is never kept; it is in the component of its text's other
    rows, and if none of those has a doc_id, its component_id is null and it is
    linked with nothing else.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = write_shared(docs.mapInArrow(trimmed(_signed), "doc_id long, n_shingles long, digest string, tokens array<long>"), "signed")
    # The sides of joins on keys that may be hot are tables: then Spark can split a hot key.
    first = write_shared(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "first")
    classes = write_shared(signed.select("doc_id", "n_shingles", "digest").join(first, "digest"), "classes").select("doc_id", "n_shingles", "class_id")
    heads = first.select(F.col("class_id").alias("doc_id"), F.col("digest"))
    heads = signed.join(heads, ["doc_id", "digest"]).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("doc"), "n_shingles", "tokens")

    posted = heads.select("doc", F.explode("tokens").alias("token"))
    often = write_shared(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "often")
    shared = posted.join(often, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"), F.sum("n").alias("central"))
    reach = COORDS - MIN_MATCHES + 1 - (COORDS - F.size("own"))
    shared = shared.where(reach > 0).select("doc", "central", reach.alias("n_prefix"), F.col("own.token").alias("tokens"))
    shared = write_shared(shared.join(heads.select("doc", "n_shingles"), "doc"), "shared")

    lists = shared.select("doc", "n_shingles", "central", F.explode(F.slice("tokens", 1, F.col("n_prefix"))).alias("token"))
    hubs = lists.groupBy("token").agg(F.count("*").alias("n"), F.max(F.struct("central", -F.col("doc"), "n_shingles")).alias("hub")).where("n > 1")
    hubs = write_shared(hubs.select("token", (-F.col("hub.col2")).alias("hub"), F.col("hub.n_shingles").alias("hub_size")), "hubs")
    fits = 100 * F.least("n_shingles", "hub_size") >= PERCENT * F.greatest("n_shingles", "hub_size")
    stars = write_shared(lists.join(hubs, "token").where(F.col("doc") != F.col("hub")).where(fits).select("hub", "doc").distinct(), "stars")
    chunks = stars.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    fellows = stars.join(chunks, "hub").select("hub", F.pmod(F.xxhash64("doc"), "n").cast("int").alias("chunk"), "doc", F.lit(False).alias("is_hub"))
    centres = chunks.select("hub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk"), F.col("hub").alias("doc"), F.lit(True).alias("is_hub"))
    compared = _texts(fellows.union(centres), docs).groupBy("hub", "chunk")
    links = write_shared(compared.applyInArrow(_star_links, "a long, b long"), "links")

    near = components(links)
    placed = shared.join(near.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    placed = placed.select("doc", "n_shingles", "n_prefix", "tokens", "component")
    mixed = placed.select("component", F.explode(F.slice("tokens", 1, F.col("n_prefix"))).alias("token"))
    mixed = mixed.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = write_shared(mixed.where("lo <> hi").select("token", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "mixed")
    tiles = placed.withColumn("token", F.explode(F.slice("tokens", 1, F.col("n_prefix")))).join(mixed, "token")
    tiles = tiles.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "component", "n_shingles", "n_prefix", "tokens")
    kind = "token long, lo int, hi int, block int, doc long, component long, n_shingles long, n_prefix int, tokens array<long>"
    doubtful = write_shared(tiles.groupBy("token", "lo", "hi").applyInArrow(_tile_members, kind), "doubtful")
    more = _texts(doubtful, docs).groupBy("token", "lo", "hi").applyInArrow(_tile_links, "a long, b long")
    more = write_shared(more, "links")
    bridge = {c: near.withColumnRenamed("node", c).withColumnRenamed("component", f"{c}_in") for c in "ab"}
    joined = more.join(bridge["a"], "a", "left").join(bridge["b"], "b", "left")
    joined = joined.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    last = components(joined)
    whole = near.join(last.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    whole = whole.select(F.col("node").alias("class_id"), F.coalesce("top", "component").alias("component_id"))
    lone = last.join(near.select("node"), "node", "left_anti").select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    whole = whole.union(lone)
    placed = classes.join(whole, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4}
#: All pairs that share a shingle, by the contract's words; for small tables.
ORACLE = {
    "op4_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(list_slice(w, i, i + {WORDS - 1}), ' ')))
                                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS shingle FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
        edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT x AS doc_id, x AS other FROM edge UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.other = edge.x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, coalesce(m.least, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY 1) m USING (doc_id)""",
}
