"""N-gram Jaccard join with signature trees.

Which sets can have a partner at all is asked without shipping texts:

1. Every document sends the shingles below a hash threshold.  A set with a
   partner shares all but a quarter of its shingles, so one that shares too few
   of the sent ones is out.  Of equal sets, only the smallest document goes on.
2. The sets that are left send all shingles and learn how many sets hold each.
   Shingles in the order of rarity give each set a prefix; linked sets share a
   shingle of their prefixes.  A set whose unshared shingles fill the prefix is
   out.
3. Sets that are alike by their smallest hashes meet in nodes of a bounded
   number of sets, and a signature tree finds the links in each node.
4. Prefix shingles held by more than one component name the pairs of nodes that
   are still open, if the sizes and what precedes the shingle in both sets leave
   room for a link; their trees are traversed against each other.

Only links that connect components are kept, so a group of copies costs as
many links as it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import ask, signature_tree, words
from tallyforge.llm.common import stage, table
from tallyforge.llm.components import components

SHINGLE = 5
PERCENT = 75
#: Share of the hash space that the first question covers; above the quarter that may be unshared.
SENT = 0.375
NODE_SETS = 256
#: Orders of the smallest hash by which sets meet in nodes.
ORDERS = 3
#: Rows without an id of their own (null, or an id that came before) get numbers from here on.
OWN_IDS = 1 << 62
TOKENS, SETS = 0, 1
FOUND = "row_id long, doc_id long, n_shingles long, set_a long, set_b long, keys binary"


def shingle_sets(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every document's distinct shingles, sorted by document and hash."""
    owners, hashes, n = [], [], 0
    for w in words.words_of(text, lower=True):
        document, position = words.window_positions(w.count, shingle)
        owners.append(n + document)
        hashes.append(words.windows(w.hash, shingle, 31)[position])
        first = np.cumsum(w.count) - w.count
        for k in range(1, shingle):
            short = np.flatnonzero(w.count == k)
            if len(short):
                owners.append(n + short)
                hashes.append(words.windows(w.hash, k, 40 + k)[first[short]])
        n += len(w.count)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    key = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], key[new]


class Chunk:
    """Documents of one chunk in a fixed order with their shingle sets."""

    def __init__(self, rows: pa.Table, shingle: int, percent: int) -> None:
        rows = rows.set_column(rows.column_names.index("text"), "text", pc.fill_null(rows.column("text"), ""))
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = rows.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        self.rows, self.n = rows, len(rows)
        self.owner, self.key = shingle_sets(text, shingle)
        self.size = np.bincount(self.owner, minlength=self.n)
        self.cut = np.cumsum(self.size) - self.size
        self.percent = percent
        mixed = words.mix(self.key)
        self.set_a = words.mix(self._sums(mixed) + self.size.astype(np.uint64))
        self.set_b = words.mix(self._sums(words.mix(mixed ^ np.uint64(0x5851F42D4C957F2D))))

        ids = rows.column("doc_id").fill_null(0).to_numpy()
        known = rows.column("doc_id").is_valid().to_numpy()
        plain = known & np.append(True, ids[1:] != ids[:-1] if self.n else [])[:self.n]
        plain[1:] |= known[1:] & ~known[:-1]
        own = words.mix(self.set_a ^ words.mix(ids.astype(np.uint64))) >> np.uint64(2)
        self.row_id = np.where(plain, ids, OWN_IDS | own.astype(np.int64))

    def _sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return total[self.cut + self.size] - total[self.cut]

    def sent(self) -> tuple[np.ndarray, np.ndarray]:
        """Owner and question key of the shingles below the threshold."""
        below = self.key < np.uint64(int(SENT * 2**64))
        return self.owner[below], words.mix(self.key[below])

    def signatures(self):
        """Sorted distinct set signatures, the smallest row of each, and each document's place among them."""
        some = np.flatnonzero(self.size)
        more = (self.set_b[some] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((self.row_id[some], more, self.set_a[some]))
        a, b, ids = self.set_a[some][order], more[order], self.row_id[some][order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        return some, a[new], b[new], ids[new], place

    def promising(self, replies: pa.Table, buckets: int) -> np.ndarray:
        """Documents that may have a partner and are the first of their set."""
        owner, key = self.sent()
        distinct, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        shared = (ask.bits_for(replies, TOKENS, distinct, buckets) | (n > 1))[inverse]
        sent = np.bincount(owner, minlength=self.n)
        held = np.bincount(owner, weights=shared, minlength=self.n)
        may_miss = self.size - signature_tree.needed_of_one(self.size, self.percent)
        keep = (self.size > 0) & (held >= sent - may_miss)
        some, a, _, ids, place = self.signatures()
        later = ask.bits_for(replies, SETS, a, buckets)[place] | (self.row_id[some] > ids[place])
        keep[some[later]] = False
        once = np.zeros(self.n, dtype=bool)
        once[np.unique(self.row_id, return_index=True)[1]] = True
        return keep & once


def sets_to_compare(docs: DataFrame, shingle: int, percent: int, docs_per_chunk: int) -> DataFrame:
    """``FOUND`` for every document; ``keys`` only for sets that may have a partner."""
    chunks, buckets = ask.sizes(docs, docs_per_chunk)
    texts = ask.chunked(docs, chunks, "text")

    def question(rows: pa.Table) -> pa.Table:
        own = Chunk(rows, shingle, percent)
        chunk = rows.column("chunk")[0].as_py()
        _, a, b, ids, _ = own.signatures()
        return ask.as_table(ask.questions(chunk, TOKENS, buckets, np.unique(own.sent()[1]))
                            + ask.questions(chunk, SETS, buckets, a, b, ids), ask.QUESTION)

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        own = Chunk(rows, shingle, percent)
        keep = own.promising(replies, buckets)
        keys = [own.key[c:c + n].astype("<u8").tobytes() if k else None
                for c, n, k in zip(own.cut.tolist(), own.size.tolist(), keep.tolist())]
        return pa.table([pa.array(own.row_id), own.rows.column("doc_id"), pa.array(own.size, pa.int64()),
                         pa.array(own.set_a.view(np.int64)), pa.array(own.set_b.view(np.int64)),
                         pa.array(keys, pa.binary())], names=[f.split()[0] for f in FOUND.split(", ")])

    return ask.tell(texts, ask.answers(ask.ask(texts, question)), finish, FOUND)


def _join_keys(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    keys = [np.frombuffer(k, "<u8") for k in rows.column("keys").to_pylist()]
    return keys, np.repeat(np.arange(len(keys)), [len(k) for k in keys])


def prefixes(sets: DataFrame, percent: int, docs_per_chunk: int) -> DataFrame:
    """Sets that can still have a partner: row_id, size n, prefix (shingle hashes), smallest hashes."""
    chunks, buckets = ask.sizes(sets, docs_per_chunk)
    dealt = sets.select("row_id", "keys", F.pmod(F.xxhash64("row_id"), F.lit(chunks)).cast("int").alias("chunk"))

    def question(rows: pa.Table) -> pa.Table:
        keys, _ = _join_keys(rows)
        distinct, n = np.unique(words.mix(np.concatenate(keys)), return_counts=True)
        return ask.as_table(ask.questions(rows.column("chunk")[0].as_py(), ask.COUNTED, buckets, distinct, None, n),
                            ask.QUESTION)

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        keys, owner = _join_keys(rows)
        flat = np.concatenate(keys)
        distinct, inverse = np.unique(words.mix(flat), return_inverse=True)
        rarity = ask.levels_for(replies, ask.COUNTED, distinct, buckets)[inverse].astype(np.int64)
        size = np.array([len(k) for k in keys])
        length = size - signature_tree.needed_of_one(size, percent) + 1
        order = np.lexsort((flat, rarity, owner))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        use = (nth < length[owner]) & (rarity[order] > 0)
        least = [np.minimum.reduceat(words.mix(flat ^ np.uint64(k << 40)), np.cumsum(size) - size).view(np.int64)
                 for k in range(ORDERS)]
        ids, out = rows.column("row_id").to_pylist(), []
        held = flat[order][use].view(np.int64)
        cuts = np.cumsum(np.bincount(owner[use], minlength=len(keys)))
        for i, part in enumerate(np.split(held, cuts[:-1])):
            if len(part):
                out.append((ids[i], int(size[i]), part.tolist(), [int(x[i]) for x in least]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)],
                        names=["row_id", "n", "prefix", "least"])

    return ask.tell(dealt, ask.answers(ask.ask(dealt, question)), finish,
                    "row_id long, n long, prefix array<long>, least array<long>")


#: Sizes that differ by less than one part in so many, or about, are bounded together.
SIZE_CLASSES = 50
#: Stars go on while a round links one set in so many.
STAR_SHARE = 100


def _tree_links(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in rows.column("keys").to_pylist()]
        ids = rows.column("row_id").to_pylist()
        side = rows.column("side").to_numpy()
        pairs = signature_tree.links(keys, rows.column("component").to_numpy(), None if (side < 0).all() else side,
                                     percent)
        return pa.table([pa.array([ids[i] for i, _ in pairs], pa.int64()),
                         pa.array([ids[j] for _, j in pairs], pa.int64())], names=["u", "v"])
    return run


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    label = components(links).withColumnRenamed("node", "row_id")
    return sets.join(label, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))


def _nodes(sets: DataFrame, order: int, nodes: int, node_sets: int) -> DataFrame:
    """Add ``node`` and ``parts``: sets that share their smallest hash in one order meet in a node.

    A node with too many sets is split by document, so no task gets an
    unbounded group.
    """
    placed = sets.withColumn("first", F.pmod(F.xxhash64(F.element_at("least", order)), F.lit(nodes)))
    load = placed.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / F.lit(2.0 * node_sets)).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row_id"), F.col("parts"))).otherwise(0)
    return placed.join(load, "first").withColumn("node", F.struct("first", part.alias("part"))).drop("first")


def _links_in_nodes(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within the nodes that hold more than one component; ``placed`` has no keys.

    Part p of a split node also meets part p + 1, which ties a large group together.
    """
    meeting = F.when(F.col("parts") > 1, F.array(F.col("node.part"), F.pmod(F.col("node.part") + 1, F.col("parts")))
                     ).otherwise(F.array(F.col("node.part")))
    dealt = placed.select("row_id", "component", F.col("node.first").alias("a"), F.explode(meeting).alias("b"))
    open_ = (dealt.groupBy("a", "b").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .filter("low < high").select("a", "b"))
    return (dealt.join(open_, ["a", "b"]).join(sets, "row_id").withColumn("side", F.lit(-1))
            .groupBy("a", "b").applyInArrow(_tree_links(percent), "u long, v long"))


def _held(known: DataFrame, percent: int) -> DataFrame:
    """Prefix shingles (token, row_id, node, component, n, cap) that sets of different components may link by.

    ``cap`` is the largest size of a partner of which the shingle is the first
    common one: what is before it in the set's order is not shared.  A pair is
    named by its first common shingle, where both sizes are within the other's
    cap; a set that is within no cap, or caps all others, is left out.
    """
    # Shingles of one holder come first in the order and are not listed.
    before = F.expr(f"n - (n * {percent} + 99) div 100 + 1 - size(prefix)") + F.col("pos")
    tokens = (known.select("row_id", "node", "component", "n", "prefix", F.posexplode("prefix").alias("pos", "token"))
              .withColumn("rest", F.col("n") - before)
              .select("token", "row_id", "node", "component", "n",
                      F.expr(f"rest * {100 + percent} div {percent} - n").alias("cap")))
    open_ = (tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.min("n").alias("least"), F.max("cap").alias("most"))
             .filter("low < high").select("token", "least", "most"))
    return stage(tokens.join(open_, "token").filter("cap >= least AND n <= most").drop("least", "most"))


def _links_across(known: DataFrame, sets: DataFrame, percent: int, star: bool = False) -> DataFrame:
    """Links between nodes: prefix shingles of more than one component name the pairs of nodes.

    With ``star`` a shingle pairs its nodes only with one of them, that of its
    smallest component, which takes work linear in the shingle's sets.
    """
    held = _held(known, percent).withColumn(
        "sizes", F.lit(0) if star else F.floor(F.log(F.col("n").cast("double")) * SIZE_CLASSES))
    ends = held.groupBy("token", "node", "component", "sizes").agg(F.min("n").alias("low"), F.max("cap").alias("cap"))
    other = ends.toDF("token", "node_2", "component_2", "sizes_2", "low_2", "cap_2")
    if star:
        hub = other.groupBy("token").agg(F.min(F.struct("component_2", "node_2", "sizes_2", "low_2", "cap_2")).alias("hub"))
        other = hub.select("token", "hub.*")
    differ = "component <> component_2" if star else "component < component_2"
    cells = stage(ends.join(other, "token").filter(f"{differ} AND node <> node_2 AND low <= cap_2 AND low_2 <= cap"))
    # Each side of a cell takes part with the sets that the other side's bounds admit.
    sides = [("node", "node_2", "component", "sizes", "low_2", "cap_2"), ("node_2", "node", "component_2", "sizes_2", "low", "cap")]
    met = None
    for at, with_, component, sizes, low, cap in sides:
        asked = (cells.groupBy("token", F.col(at).alias("node"), F.col(with_).alias("other"),
                               F.col(component).alias("component"), F.col(sizes).alias("sizes"))
                 .agg(F.min(low).alias("low"), F.max(cap).alias("most")))
        mine = (asked.join(held, ["token", "node", "component", "sizes"]).filter("n <= most AND low <= cap")
                .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "row_id", "component",
                        F.when(F.col("node") < F.col("other"), 0).otherwise(1).alias("side")))
        met = mine if met is None else met.unionByName(mine)
    return (met.distinct().join(sets, "row_id").groupBy("a", "b")
            .applyInArrow(_tree_links(percent), "u long, v long"))


def connecting_links(sets: DataFrame, prefix: DataFrame, percent: int, node_sets: int = NODE_SETS) -> DataFrame:
    """Links (u, v) that connect all sets which links connect; ``sets`` has row_id and keys."""
    prefix = stage(prefix)
    nodes = max(1, prefix.count() // node_sets)
    placed = stage(_nodes(prefix, 1, nodes, node_sets))
    links = stage(_links_in_nodes(placed.withColumn("component", F.col("row_id")), sets, percent))
    for order in range(2, ORDERS + 1):
        known = _labelled(_nodes(prefix, order, nodes, node_sets), links)
        links = stage(links.unionByName(_links_in_nodes(known, sets, percent)))
    sets_here = placed.select("row_id", "node", "n", "prefix")
    known = stage(_labelled(sets_here, links))
    # Stars first: a large group of near copies becomes one component before all pairs of its nodes are named.
    while True:
        star = stage(_links_across(known, sets, percent, star=True))
        found = star.count()
        links = stage(links.unionByName(star))
        known = stage(_labelled(sets_here, links))
        # A round that joins few sets leaves little to the exact step below.
        if found < max(1, prefix.count() // STAR_SHARE):
            break
    return links.unionByName(_links_across(known, sets, percent))


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                   docs_per_chunk: int = ask.DOCS_PER_CHUNK, node_sets: int = NODE_SETS) -> DataFrame:
    """Per row: doc_id, n_shingles (size of the set of distinct shingles) and component_id.

    Two documents link when their sets' Jaccard similarity is at least
    ``percent`` / 100; component_id is the smallest doc_id reachable by links.
    Words are compared with A-Z as a-z.  A text with fewer words than a shingle
    is one shingle; a null text or one without words has an empty set, links
    with nothing and is its own component.  Rows that share a doc_id are one
    node: a link of one of them links them all.  A row with a null doc_id takes
    part; its component_id is null where no row with an id is reachable.  An empty table gives no rows.  Other columns are not read.
    """
    found = stage(sets_to_compare(docs, shingle, percent, docs_per_chunk))
    sets = found.filter("keys IS NOT NULL").select("row_id", "keys")
    links = connecting_links(sets, prefixes(sets, percent, docs_per_chunk), percent, node_sets)
    equal = found.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("row_id").alias("v"))
    copies = (found.filter("n_shingles > 0").join(equal, ["set_a", "set_b"])
              .select(F.col("row_id").alias("u"), "v"))
    same_id = found.filter("doc_id IS NOT NULL AND doc_id <> row_id").select(F.col("row_id").alias("u"),
                                                                             F.col("doc_id").alias("v"))
    label = components(links.unionByName(copies).unionByName(same_id)).withColumnRenamed("node", "row_id")
    component = F.coalesce(F.col("component"), F.col("row_id"))
    return (found.join(label, "row_id", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull() | (component < OWN_IDS), component).alias("component_id")))


#: A list of ids up to this long is sent to all tasks, so that texts need not be shuffled to drop some.
SENT_IDS = 1_000_000


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their group; null ids and empty texts stay.

    The list of the others is sent to all tasks if it is short, and joined by
    shuffling if it is not.
    """
    others = stage(jaccard_groups(docs, **options).filter("component_id <> doc_id")
                   .select(F.col("doc_id").alias("copy_doc_id")).distinct())
    if others.count() <= SENT_IDS:
        others = F.broadcast(others)
    return docs.join(others, F.col("doc_id") == F.col("copy_doc_id"), "left_anti")


def op2_jaccard(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
  UNION ALL
  SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b
  WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id
"""
