"""Near duplicates by a chosen-path similarity join.

Documents with equal shingle sets form a class; a class is one record. Each
record walks down several independent trees: a node picks one coordinate of
the MinHash signature, sometimes two, and a record goes on to the children
named by its own values there. Small nodes are compared exhaustively, large
ones branch further. What looks alike is gathered into clusters, and within
these every link is confirmed on the full sets before components are taken.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import hand_back, release, sliced
from .components import components

COORDINATES = 128
NODE_LIMIT = 256
START_DEPTH = 3
MOST_DEPTH = 16
BLOCK = 512
BLOCK_SHINGLES = 4_000_000
PIVOTS = 32
CHUNK = 64
SEED = 20_251
_LINKS = "u binary, v binary, whole boolean"


def trees_needed(similarity: float, recall: float, depth: int = START_DEPTH + 2) -> int:
    """How many trees bring two records of just this similarity together with chance `recall`.

    At each level the pair goes on through one coordinate with chance
    `similarity`, or through one of two where the node picked two.
    """
    two, meet = 1 / similarity - 1, 1.0
    for _ in range(depth):
        one = similarity * meet
        meet = (1 - two) * one + two * (1 - (1 - one) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _shingle_function(shingle: int, coordinates: int, with_sets: bool):
    """Arrow batches of texts to sizes, set keys and signatures, or to the sets themselves."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import xxhash

        release()  # what an earlier operator left would stay beside all steps of this one
        draw = np.random.default_rng(SEED)
        factors = draw.integers(1, 2**32, coordinates, dtype=np.uint32) | np.uint32(1)
        offsets = draw.integers(0, 2**32, coordinates, dtype=np.uint32)
        digest = xxhash.xxh3_64_intdigest
        prime, mixer = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

        def shingles(text):
            words = text.encode().lower().split()
            if not words:
                return np.zeros(0, np.uint64)
            hashes = np.fromiter(map(digest, words), np.uint64, len(words))
            width = min(shingle, len(words))
            mixed = np.full(len(words) - width + 1, width, np.uint64)
            for k in range(width):
                mixed = mixed * prime + hashes[k : k + len(mixed)]
                mixed ^= mixed >> np.uint64(29)
            mixed *= mixer
            mixed ^= mixed >> np.uint64(32)
            return np.unique(mixed)

        def signature(found):
            least = np.full(coordinates, 2**32 - 1, np.uint32)
            narrow = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
            for start in range(0, len(narrow), 4096):
                value = (narrow[start : start + 4096, None] ^ offsets) * factors
                value ^= value >> np.uint32(15)
                least = np.minimum(least, value.min(axis=0))
            return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()

        for batch in sliced(batches):
            sizes, keys, signatures, sets = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text or "")
                sizes.append(len(found))
                if with_sets:
                    sets.append(found.tobytes())
                else:
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            kept = [n for n in batch.schema.names if n != "text"]
            made = {"set": pa.array(sets, pa.binary())} if with_sets else {
                "n_shingles": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary())}
            made["signature"] = pa.array(signatures, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(made.values()), kept + list(made))

    return run


def _branch(rows, nodes, signatures, extra: int):
    """The children of (row, node) pairs: rows again, and the children's numbers."""
    import numpy as np

    def child(at, place):
        value = signatures[rows[at], place].astype(np.uint64)
        mixed = (nodes[at] ^ (place.astype(np.uint64) << np.uint64(8) | value)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        return mixed ^ mixed >> np.uint64(29)

    width = signatures.shape[1]
    everyone = np.arange(len(rows))
    first = (nodes % np.uint64(width)).astype(np.int64)
    again = np.flatnonzero((nodes >> np.uint64(16) & np.uint64(0xFFFF)) < np.uint64(extra))
    second = (nodes[again] >> np.uint64(40)).astype(np.int64) % (width - 1)
    second += second >= first[again]
    return (np.concatenate([rows, rows[again]]),
            np.concatenate([child(everyone, first), child(again, second)]))


def _signatures(column, width: int):
    import numpy as np

    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), width)


def _walk_function(trees: int, depth: int, similarity: float, coordinates: int):
    """From the roots of all trees down to `depth`; or one level down, where rows name their node."""
    extra = int((1 / similarity - 1) * 65536)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches, 4096):
            marks = _signatures(batch.column("signature"), coordinates)
            count = len(marks)
            if not count:
                continue
            if "node" in batch.schema.names:
                rows, levels = np.arange(count), 1
                nodes = np.asarray(batch.column("node").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                parents = np.asarray(batch.column("n").to_numpy(zero_copy_only=False), np.int64)
            else:
                rows, levels = np.tile(np.arange(count), trees), depth
                nodes = np.repeat(
                    np.random.default_rng(SEED + 1).integers(0, 2**63, trees, dtype=np.uint64), count)
                parents = np.zeros(count, np.int64)
            for _ in range(levels):
                rows, nodes = _branch(rows, nodes, marks, extra)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes.view(np.int64)), batch.column("key").take(pa.array(rows)), pa.array(parents[rows])],
                ["node", "key", "parent"])

    return run


def _grouped(batches, names):
    """Tables of whole groups, from batches sorted by the columns `names`."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, now]) if held is not None else now
        ids = [held.column(n).to_numpy() for n in names]
        changes = np.zeros(held.num_rows, bool)
        for values in ids:
            changes[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(changes)
        if len(starts):
            yield held.slice(0, starts[-1]), np.concatenate([[0], starts[:-1]]), starts
            held = held.slice(starts[-1])
    if held is not None:
        yield held, np.array([0]), np.array([held.num_rows])
    batch = now = held = None
    hand_back()


def _alike_function(least: float, coordinates: int):
    """Edges from the members of each node's look-alike groups to their first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for table, starts, ends in _grouped(batches, ["node"]):
            marks = _signatures(table.column("signature"), coordinates)
            left, right = [], []
            twos = starts[ends - starts == 2]
            alike = twos[(marks[twos] == marks[twos + 1]).mean(axis=1) >= least]
            left += (alike + 1).tolist()
            right += alike.tolist()
            for start, end in zip(starts, ends):
                if end - start < 3:
                    continue
                own = marks[start:end]
                near = np.stack([(own == row).mean(axis=1) >= least for row in own])
                label = np.arange(len(own))
                while True:
                    lower = np.where(near, label, len(own)).min(axis=1)
                    if (lower == label).all():
                        break
                    label = lower
                others = np.flatnonzero(label != np.arange(len(own)))
                left += (others + start).tolist()
                right += (label[others] + start).tolist()
            keys = table.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(left, pa.int64())), keys.take(pa.array(right, pa.int64()))], ["u", "v"])

    return run


def _confirm_function(percent: int, least_alike: float, coordinates: int, against_rest: bool):
    """Confirmed links of each group, enough of them to connect whatever is linked.

    A pair is compared on its full sets unless it is already connected, or
    its signatures rule the link out. Each component of a group is tied to its
    first key; `whole` says that the group is all of its cluster. With `against_rest`, only rows marked
    as `rest` are compared with the others, and rows that share a `root` are
    connected from the start.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(a, b):
            low, high = sorted((len(a), len(b)))
            if 100 * low < percent * high:
                return False
            shared = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * shared >= percent * (low + high - shared)

        for table, starts, ends in _grouped(batches, ["cluster", "block", "chunk"]):
            for start, end in zip(starts.tolist(), ends.tolist()):
                part = table.slice(start, end - start)
                keys = part.column("key").to_pylist()
                first = {k: i for i, k in reversed(list(enumerate(keys)))}
                at = sorted(first.values())
                keys = [keys[i] for i in at]
                part = part.take(pa.array(at))
                sets = [np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()]
                marks = _signatures(part.column("signature"), coordinates)
                if against_rest:
                    roots = part.column("root").to_pylist()
                    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
                    label = np.array([names[r] for r in roots])
                    asking = np.flatnonzero(part.column("rest").to_numpy()).tolist()
                else:
                    label = np.arange(len(keys))
                    asking = range(1, len(keys))
                pairs = []
                for i in asking:
                    other = marks if against_rest else marks[:i]
                    alike = (other == marks[i]).mean(axis=1)
                    near = np.flatnonzero(alike >= least_alike)
                    for j in near[np.argsort(-alike[near], kind="stable")].tolist():
                        if label[i] != label[j] and linked(sets[i], sets[j]):
                            pairs.append((keys[i], keys[j]))
                            label[label == label[i]] = label[j]
                if not against_rest:
                    least = {}
                    for mark, key in zip(label.tolist(), keys):
                        least[mark] = min(key, least.get(mark, key))
                    pairs = [(key, least[mark]) for mark, key in zip(label.tolist(), keys) if key != least[mark]]
                if pairs:
                    whole = pa.array([not against_rest and max(part.column("blocks").to_pylist()) == 1] * len(pairs))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.binary()) for c in zip(*pairs)), whole], ["u", "v", "whole"])

    return run


def _leaves(records: DataFrame, trees: int, similarity: float, coordinates: int,
            limit: int) -> tuple[DataFrame, DataFrame]:
    """(node, key) of all small nodes that hold two or more, and edges that tie the records of each other node.

    A node over the limit branches further while that still divides it. One
    whose children stay as large holds records alike in most coordinates. Its signatures are
    not compared: all its records go to one cluster, in which every link is looked for.
    """
    walk = _walk_function(trees, START_DEPTH, similarity, coordinates)
    described = "node long, key binary, parent long"
    paths = records.select("key", "signature").mapInArrow(walk, described)
    found = tied = None
    for depth in range(START_DEPTH, MOST_DEPTH + 1):
        counted = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head")).where("n > 1")
        level = stage(paths.join(counted, "node"), "paths")
        goes_on = (F.col("n") > limit) & ((F.col("parent") == 0) | (F.col("n") < 0.6 * F.col("parent")))
        if depth == MOST_DEPTH:
            goes_on = F.lit(False)
        done = level.where(~goes_on & (F.col("n") <= limit)).select("node", "key")
        edges = level.where(~goes_on & (F.col("n") > limit) & (F.col("key") != F.col("head"))).select(
            F.col("key").alias("u"), F.col("head").alias("v"))
        found = done if found is None else found.unionByName(done)
        tied = edges if tied is None else tied.unionByName(edges)
        large = level.where(goes_on)
        if large.isEmpty():
            break
        paths = large.join(records.select("key", "signature"), "key").select(
            "node", "key", "n", "signature").mapInArrow(walk, described)
    return found, tied


def _clusters(records: DataFrame, trees: int, similarity: float, least: float, coordinates: int,
              limit: int) -> DataFrame:
    """(key, cluster) of all records that look like another one."""
    leaves, tied = _leaves(records, trees, similarity, coordinates, limit)
    edges = (
        leaves.join(records.select("key", "signature"), "key")
        .select("node", "key", "signature")
        .repartition("node").sortWithinPartitions("node")
        .mapInArrow(_alike_function(least, coordinates), "u binary, v binary"))
    return components(edges.unionByName(tied)).select(F.col("node").alias("key"), F.col("root").alias("cluster"))


def _confirmed(members: DataFrame, percent: int, least: float, coordinates: int) -> DataFrame:
    """(key, root) by confirmed links. `members`: key, cluster, set, signature, and the cluster's `m` and `total`.

    A cluster is cut into blocks of bounded size. Each block is solved whole,
    together with pivots that go to all blocks. What is then outside the
    largest component of its cluster is compared with all of the cluster, in
    chunks against blocks: two records outside each other's component cannot
    both be in the largest, so no link is left out.
    """
    placed = stage(
        members.withColumn("blocks", F.greatest(
            F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
        .withColumn("place", F.xxhash64("key"))
        .withColumn("block", F.pmod("place", F.col("blocks")).cast("int"))
        .withColumn("pivot", (F.col("blocks") > 1) & (F.pmod(F.shiftright("place", 20), F.col("m")) < PIVOTS)),
        "members")
    everywhere = F.explode(F.when(
        F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    dealt = F.xxhash64("cluster")
    links = stage(
        placed.select(dealt.alias("cluster"), everywhere.alias("block"), F.lit(0).alias("chunk"), "key", "blocks", "set",
                      "signature")
        .repartition("cluster", "block").sortWithinPartitions("cluster", "block", "chunk")
        .mapInArrow(_confirm_function(percent, least, coordinates, False), _LINKS), "links")
    whole = links.where("whole").select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = whole.unionAll(whole.select(F.col("root").alias("node"), "root").distinct())
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return whole
    found = components(links.where("NOT whole"))
    rooted = large.select("key", "cluster", "blocks", "block").join(
        found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = stage(rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("head")), "heads")
    marked = stage(rooted.join(heads, "cluster").withColumn("rest", F.col("root") != F.col("head")).drop("head"), "rest")
    rests = stage(marked.where("rest").groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "rests")
    asked = marked.join(rests, "cluster")
    chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")
    rows = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn(
        "rest", F.lit(False)).select("key", "cluster", "root", "block", "chunk", "rest").unionByName(
        asked.where("rest").withColumn("chunk", chunk)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "cluster", "root", "block", "chunk", "rest"))
    more = (
        rows.groupBy("key", "cluster", "root", "block", "chunk").agg(F.max("rest").alias("rest"))
        .join(large.select("key", "set", "signature"), "key")
        .select(dealt.alias("cluster"), "block", "chunk", "key", "root", "rest", "set", "signature")
        .repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk")
        .mapInArrow(_confirm_function(percent, least, coordinates, True), _LINKS))
    return whole.unionByName(components(links.where("NOT whole").unionByName(more)))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, recall: float = 0.999,
                    coordinates: int = COORDINATES, limit: int = NODE_LIMIT, with_hash: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of `docs`.

    `with_hash` adds `text_hash`, the row's xxhash64 of its text.

    Two documents are linked if 100 * intersection >= `percent` * union of
    their sets of distinct `shingle`-word sequences, A-Z in lower case; with
    fewer words the whole sequence is the one element. `component_id` is the
    smallest id reachable over links, `kept` marks its document. `recall` is
    the chance with which the trees find a link of just `percent` where nodes
    need not go deeper than two levels below the start; it is lower for pairs
    in nodes that branch on. No node is cut: what cannot be branched is one cluster.

    Null, empty and blank texts have no set, link with nothing and are kept.
    Rows with one id twice are separate members of their component. A null
    id never is a component's id unless all members have none, and then all
    are kept. Other columns are not read.

    Texts are read twice: once for sizes and signatures, and again for the
    full sets of records that look like another. Copies with one set are a
    single record throughout, so a group of copies costs one join at the end.
    """
    similarity = percent / 100
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / coordinates)
    trees = trees_needed(similarity, recall)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = stage(
        texts.mapInArrow(
            _shingle_function(shingle, coordinates, False),
            "doc_id long, text_hash long, n_shingles long, key binary, signature binary"), "signatures")
    records = stage(
        rows.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature")), "records")
    clusters = _clusters(records, trees, similarity, least, coordinates, limit)
    # Sizes of groups are written out before they are joined back, so that both
    # sides come straight from a shuffle and a large group can be split.
    found = stage(
        records.select("key", "n_shingles", "first.doc_id", "first.text_hash").join(clusters, "key"), "clusters")
    sizes = stage(found.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("total")), "cluster-sizes")
    wanted = found.join(sizes, "cluster")
    members = (
        texts.alias("t").join(
            wanted.alias("w"),
            F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash")))
        .select("w.key", "w.cluster", "w.m", "w.total", "t.text")
        .mapInArrow(
            _shingle_function(shingle, coordinates, True),
            "key binary, cluster binary, m long, total long, set binary, signature binary"))
    roots = _confirmed(members, percent, least, coordinates)
    rooted = records.select("key", "least_id").join(
        roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = stage(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    named = rooted.join(smallest, "root").select("key", "component_id")
    own = ["doc_id", "text_hash", "n_shingles"] if with_hash else ["doc_id", "n_shingles"]
    joined = rows.select(*own, "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select(*own, component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
