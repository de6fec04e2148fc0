"""Near-duplicates by order MinHash, verified by banded alignment.

Texts are sequences of five-word shingles. A shingle is labelled with how often it
occurred before in the text. For each of ``bands`` hash functions the ``take`` least
labelled shingles are sampled and kept in text order; texts that agree on a sample are in
one bucket. Unlike plain MinHash this also asks for the order, as edits keep it.

Similarity is that of an alignment: shingles matched in order, over all shingles of both
texts less the matched. It never exceeds the shingles' Jaccard similarity and equals it
for edits that move nothing. An alignment of 0.8 or more stays within a band of a ninth
of both lengths around the diagonal.

Equal texts are one node. In a bucket every node is compared with three hubs, not with
every other node: the one that shares most buckets with others, one drawn from all and
one drawn from outside the bucket's largest class. A bucket of more than ``FREQUENT`` nodes
has one hub a round and ``WIDE_ROUNDS`` of them, as what few hubs miss there more of them hardly find. Nodes that fall into one class are not
compared again; nodes that stay apart meet further hubs in later rounds. Buckets of a few
nodes are so compared in full. Nodes of buckets that hold several classes beside their
hubs after the last round are finished exactly, nodes of one class never with each other:
pairs that share a rare shingle are found by it, pairs that can be similar by frequent
shingles alone by the bucket (see ``_reachable``). A link is lost only if its ends share no
bucket (below one in 100,000 at a similarity of 0.8).

Edge cases: a null text counts as empty; texts without words are classes of equal texts;
a text of fewer than five words is one shingle; a very long text is one slice of any
length; an empty table gives an empty table; rows
that share a ``doc_id`` are told apart by text, and a null ``doc_id`` comes last as a
class id; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_rows import SLICE_BYTES, batches, binary_array, column
from .hashing import BASES, PLACE_BITS, Rolling, U, Words, mix, randoms
from .tables import fresh_name, materialize, texts

BANDS = 12
TAKE = 2
#: Nodes that a shingle may have to be joined by it.
FREQUENT = 64
#: Rounds in which a bucket of more nodes has a hub.
WIDE_ROUNDS = 2
MOST = U(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int):
    """Hashes of the word shingles of each text of a slice, and where each text's start."""
    words = Words(data, offsets)
    rolling = Rolling(words.hashes(1), BASES[0])
    count = np.diff(words.first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    end = at + np.repeat(np.minimum(count, size), n)
    return rolling.spans(at, end), first


def labelled(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each shingle's hash with the number of earlier occurrences in its text mixed in."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first)).astype(U)
    key = mix(values + mix(text))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.ones(len(key), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    start = np.flatnonzero(head)
    nth = np.empty(len(key), np.int64)
    nth[order] = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return np.where(nth == 0, values, mix(values + nth.astype(U) * BASES[1]))


def order_sketch(values: np.ndarray, first: np.ndarray, bands: int, take: int) -> np.ndarray:
    """Per text (with shingles) and band one hash of its least labelled shingles in text order."""
    labels = labelled(values, first)
    some = np.flatnonzero(np.diff(first) > 0)
    heads = first[some]
    place = U((1 << PLACE_BITS) - 1)
    # The place in the low bits lets one pass over all texts find the least; where a slice
    # is longer than these bits can count, texts are looked through one by one.
    long = len(labels) > int(place)
    index = np.arange(0 if long else len(labels), dtype=U)
    factors = randoms(bands, 11)
    out = np.zeros((len(some), bands), U)
    for band in range(bands):
        keyed = mix(labels * factors[band]) & ~place
        if not long:
            keyed |= index
        places = np.full((len(some), take), len(labels), np.int64)
        for t in range(take):
            left = (np.diff(first)[some] > t)
            if long:
                at = np.array([a + int(keyed[a:b].argmin()) for a, b in zip(heads.tolist(), first[some + 1].tolist())])
            else:
                at = (np.minimum.reduceat(keyed, heads) & place).astype(np.int64)
            places[left, t] = at[left]
            keyed[at[left]] = MOST
        places.sort(axis=1)
        element = np.full(len(some), band + 1, U)
        padded = np.append(labels, U(0))
        for t in range(take):
            element = mix(element * BASES[0] + padded[places[:, t]])
        out[:, band] = element
    return out


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sequences by banded alignment; 0 where it cannot reach ``least``.

    Bit-parallel longest common subsequence: bit ``i`` of the state stands for place ``i``
    of ``a``. Matches outside the band of the allowed number of gaps are left out.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    # matched / (n + m - matched) >= least  <=>  matched >= least / (1 + least) * (n + m)
    need = least / (1 + least) * (n + m)
    if min(n, m) < need - 1e-9:
        return 0.0
    gaps = int(n + m - 2 * need + 1e-9) + 1
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    state = whole = (1 << n) - 1
    width = (1 << (2 * gaps + 1)) - 1
    for j, x in enumerate(b.tolist()):
        found = where.get(x)
        if found is None:
            continue
        found &= (1 << (j + gaps + 1)) - 1 if j <= gaps else width << (j - gaps)
        hit = state & found
        state = ((state + hit) | (state & ~found)) & whole
    matched = n - state.bit_count()
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least - 1e-12 else 0.0


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the ends of ``edges (a, b)``: the least node of each component.

    Each round takes the least label among neighbours, then the label's own label, so the
    rounds follow the logarithm of a chain's length.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
        near = near.groupBy("a").agg(F.min("other").alias("other"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "other").alias("new")
        )
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        step = materialize(step.join(jump, "new").select("node", F.col("label").alias("old"), F.least("new", "jump").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components ``labels (node, label)`` with more ``links (a, b)``; only labels that links join are looked at again."""
    if labels is None:
        return components(links)
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    known = materialize(labels.unionByName(fresh))
    of = lambda end: known.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
    joined = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("of_a <> of_b")
    joined = materialize(joined.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    if joined.isEmpty():
        return known
    roots = components(joined).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return materialize(known.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def _sketches(keyed: DataFrame, size: int, bands: int, take: int) -> DataFrame:
    def sketch(frames):
        for rows, data, offsets in batches(frames):
            values, first = shingles(data, offsets, size)
            count = np.diff(first)
            found = order_sketch(values, first, bands, take) if len(values) else np.zeros((0, bands), U)
            ends = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), column(rows, "digest"), lists], ["doc_id", "digest", "sample"]
            )

    return keyed.mapInArrow(sketch, "doc_id long, digest string, sample array<long>")


def _sequences(keyed: DataFrame, size: int) -> DataFrame:
    """``(node, sequence)``: shingles as 32-bit hashes, which is what alignments compare."""

    def cut(frames):
        for rows, data, offsets in batches(frames):
            values, first = shingles(data, offsets, size)
            body = (values >> U(32)).astype("<u4").view(np.uint8)
            yield pa.RecordBatch.from_arrays([column(rows, "node"), binary_array(body, 4 * first)], ["node", "sequence"])

    return keyed.mapInArrow(cut, "node long, sequence binary")


def _links(pairs: DataFrame, sequences: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(node, hub)`` whose alignment reaches ``similarity``."""

    def align(frames):
        for batch in frames:
            ours, theirs = column(batch, "sequence"), column(batch, "hub_sequence")
            value = [
                alignment(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), similarity)
                for x, y in zip(ours, theirs)
            ]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "node"), column(batch, "hub"), pa.array(value, pa.float64())], ["a", "b", "similarity"]
            )

    hubs = sequences.select(F.col("node").alias("hub"), F.col("sequence").alias("hub_sequence"))
    both = pairs.join(sequences, "node").join(hubs, "hub").select("node", "hub", "sequence", "hub_sequence")
    return both.mapInArrow(align, "a long, b long, similarity double").filter("similarity > 0")


def _labels(sequences: DataFrame) -> DataFrame:
    """``(node, n, token)``: every labelled shingle of a sequence, and how many there are."""

    def label(frames):
        for batch in frames:
            bodies = column(batch, "sequence")
            sizes = np.array([len(x.as_buffer()) // 4 for x in bodies], np.int64)
            nodes = column(batch, "node").to_numpy()
            parts = np.cumsum(sizes) * 4 // SLICE_BYTES
            for part in np.unique(parts):
                rows = np.flatnonzero(parts == part)
                body = b"".join(bodies[int(i)].as_buffer().to_pybytes() for i in rows)
                first = np.concatenate([[0], np.cumsum(sizes[rows])])
                if not first[-1]:
                    continue
                tokens = labelled(np.frombuffer(body, "<u4").astype(U), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(nodes[rows], sizes[rows])),
                        pa.array(np.repeat(sizes[rows], sizes[rows])),
                        pa.array(tokens.view(np.int64)),
                    ],
                    ["node", "n", "token"],
                )

    return sequences.mapInArrow(label, "node long, n long, token long")


def _reachable(sequences: DataFrame, left: DataFrame, buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(node, hub)`` of ``left (node, label)`` that may reach ``similarity``, of different labels, each once, with these.

    Shingles are put in one order, rare ones first. Of two sets of n >= m shingles with a
    Jaccard similarity of at least s, the first ``n - s n + 1`` shingles of the one and
    ``m - 2 s / (1 + s) m + 1`` of the other have one in common.

    A shingle of at most ``FREQUENT`` nodes there is joined; a pair that shares any such
    shingle at all shares one there, if a node's part reaches its frequent ones. What is
    left are pairs that share frequent shingles only, so both have enough of these; they
    are met in their buckets, in the first band that they share.
    """
    tokens = materialize(_labels(sequences.join(left.select("node"), "node", "left_semi")))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    rare = F.col("often").between(2, FREQUENT)
    nodes = (
        tokens.join(often, "token")
        .groupBy("node", "n")
        .agg(
            F.count_if(F.col("often") == 1).alias("single"),
            F.count_if(F.col("often") > FREQUENT).alias("frequent"),
            F.array_sort(F.collect_list(F.when(rare, F.struct("often", "token")))).alias("rare"),
        )
        .join(left, "node")
    )
    nodes = materialize(nodes)
    need = (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    short = F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-9) + 1
    placed = nodes.select("node", "label", "n", "single", F.posexplode("rare").alias("i", "x")).select(
        "node", "label", "n", (F.col("single") + F.col("i")).alias("place"), "x.token"
    )
    hub = lambda frame, *more: frame.select(
        F.col("node").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("m"), *more
    )
    ours = hub(placed.filter(F.col("place") < short), "token", F.col("place").alias("hub_place"))
    longer = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("node") > F.col("hub")))
    able = longer & (F.col("label") != F.col("hub_label")) & (F.col("m") >= F.col("n") * similarity - 1e-9)
    pairs = placed.filter(F.col("place") < prefix).join(ours, "token").filter(able)
    pairs = pairs.groupBy("node", "hub", "label", "hub_label", "n", "m").agg(
        F.count("*").alias("common"), F.max("place").alias("place"), F.max("hub_place").alias("hub_place")
    )
    after = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("hub_place")) - 1
    named = ["node", "hub", "label", "hub_label"]
    some = pairs.filter(F.col("common") + after >= need).select(*named)
    # Nodes that may reach it by frequent shingles alone, and with whom.
    full = nodes.filter(F.col("frequent") >= F.col("n") * similarity - 1e-9).select("node", "label", "n", "frequent")
    bands = buckets.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("band", "element"))).alias("bands"))
    full = materialize(buckets.select("node", "band", "element").join(full.join(bands, "node"), "node"))
    several = full.groupBy("band", "element").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    full = full.join(several.filter("least <> most").select("band", "element"), ["band", "element"])
    theirs = hub(full, "band", "element", F.col("frequent").alias("hub_frequent"), F.col("bands").alias("hub_bands"))
    first = F.element_at(F.array_intersect("bands", "hub_bands"), 1)["band"] == F.col("band")
    enough = F.least("frequent", "hub_frequent") >= need
    rest = full.join(theirs, ["band", "element"]).filter(able & enough & first).select(*named)
    return some.unionByName(rest).distinct()


def _unmet(buckets: DataFrame, labels: DataFrame | None, used: DataFrame | None) -> DataFrame:
    """Distinct ``(node, label)`` of buckets with several classes among nodes that were no hub there."""
    live = buckets.withColumn("label", F.col("node")) if labels is None else (
        buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    if used is not None:
        live = live.join(used.withColumnRenamed("hub", "node"), ["band", "element", "node"], "left_anti")
    several = live.groupBy("band", "element").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    return live.join(several.filter("least <> most"), ["band", "element"]).select("node", "label").distinct()


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    size: int = 5,
    bands: int = BANDS,
    take: int = TAKE,
    rounds: int = 3,
) -> DataFrame:
    """Per document row ``doc_id, digest, class_id``: the least ``doc_id`` of its class.

    ``digest`` is the MD5 of the text. A class is a component of links of ``similarity``
    or more, equal texts included.
    """
    keyed = texts(docs).withColumn("digest", F.md5(F.coalesce("text", F.lit(""))))
    rows = materialize(_sketches(keyed, size, bands, take))
    nodes = materialize(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.first("sample").alias("sample"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = nodes.select("node", F.posexplode("sample").alias("band", "element"))
    wide = members.groupBy("band", "element").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = members.join(wide, ["band", "element"])
    # Hubs are the nodes with most company over all their buckets; ties by a hash.
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    buckets = materialize(buckets.join(company, "node").select("band", "element", "node", "company"))
    chosen = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "digest")
    # One row per text: the copy with the least id, or any of equal rows.
    bodies = keyed.join(chosen, "digest").groupBy("node").agg(F.first("text").alias("text"))
    sequences = materialize(_sequences(bodies, size))

    labels, met, used = None, None, None
    for turn in range(rounds):
        live = buckets.withColumn("label", F.col("node")) if labels is None else (
            buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        )
        by_label = live.groupBy("band", "element", "label").agg(F.count("*").alias("n"))
        bucket = by_label.groupBy("band", "element").agg(
            F.count("*").alias("labels"), F.sum("n").alias("nodes"), F.max(F.struct("n", "label")).alias("most")
        ).filter("labels > 1")
        fresh = live.join(bucket, ["band", "element"])
        if used is not None:
            fresh = fresh.join(used.withColumnRenamed("hub", "node"), ["band", "element", "node"], "left_anti")
        # The node with most company, one drawn from all and one from outside the largest
        # class; draws differ from bucket to bucket, so a node meets many hubs of its group.
        draw = F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("tie"), "node")
        other = F.struct(F.xxhash64("node", "band", F.lit(-1 - turn)).alias("tie"), "node")
        # A wide bucket has one hub a round, in the first rounds: that with most company, then a
        # drawn one. Where one class has most of it the hub is of that class, so that only nodes
        # beside it meet it.
        wide = F.col("nodes") > FREQUENT
        ruled = wide & (2 * F.col("most.n") > F.col("nodes"))
        within = F.col("label") == F.col("most.label")
        tops = fresh.groupBy("band", "element", wide.alias("wide")).agg(
            F.max(F.struct("company", "node")).alias("one"),
            F.max(F.when(ruled == within, draw)).alias("two"),
            F.max(other).alias("three"),
        )
        chosen = F.array_distinct(F.array_compact(F.array("one.node", "two.node", "three.node")))
        if turn < WIDE_ROUNDS:
            chosen = F.when(F.col("wide"), F.array_compact(F.array("two.node" if turn else "one.node"))).otherwise(chosen)
        else:
            tops = tops.filter(~F.col("wide"))
        tops = materialize(tops.select("band", "element", F.explode(chosen).alias("hub")))
        if tops.isEmpty():
            break
        used = tops if used is None else used.unionByName(tops)
        hub_label = live.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")).distinct()
        pairs = (
            live.join(tops, ["band", "element"])
            .join(hub_label, "hub")
            .filter("label <> hub_label")
            .select("node", "hub")
            .distinct()
        )
        if met is not None:
            pairs = pairs.join(met, ["node", "hub"], "left_anti")
        pairs = materialize(pairs)
        if pairs.isEmpty():
            continue
        found = materialize(_links(pairs, sequences, similarity))
        met = pairs if met is None else met.unionByName(pairs)
        labels = merged(labels, found)
    left = materialize(_unmet(buckets, labels, used))
    if not left.isEmpty():
        pairs = _reachable(sequences, left, buckets.select("band", "element", "node"), similarity)
        # Each node first meets one node of every other class; links found there spare it the others.
        pairs = materialize(pairs.withColumn("tie", F.xxhash64("node", "hub")))
        first = materialize(pairs.groupBy("node", "hub_label").agg(F.min_by("hub", F.struct("tie", "hub")).alias("hub")))
        if met is not None:
            met = met.unionByName(met.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
        unmet = lambda some: some if met is None else some.join(met, ["node", "hub"], "left_anti")
        found = materialize(_links(materialize(unmet(first.select("node", "hub"))), sequences, similarity))
        if not found.isEmpty():
            labels = merged(labels, found)
        rest = pairs.join(first, ["node", "hub_label", "hub"], "left_anti")
        if labels is not None:
            root = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
            rest = rest.join(root("label"), "label", "left").join(root("hub_label"), "hub_label", "left")
            rest = rest.filter(F.coalesce("of_label", "label") != F.coalesce("of_hub_label", "hub_label"))
        rest = materialize(unmet(rest.select("node", "hub")))
        if not rest.isEmpty():
            found = materialize(_links(rest, sequences, similarity))
            if not found.isEmpty():
                labels = merged(labels, found)
    classes = nodes.select("node", "digest", "least")
    if labels is not None:
        classes = classes.join(labels, "node", "left").withColumn("node", F.coalesce("label", "node"))
    least = classes.groupBy("node").agg(F.min("least").alias("class_id"))
    classes = classes.select("node", "digest").join(least, "node").select("digest", "class_id")
    return rows.select("doc_id", "digest").join(classes, "digest").select("doc_id", "digest", "class_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: that with the least id; columns unchanged.

    Of rows equal in id and text one stays.
    """
    found = near_duplicates(docs, **options)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    # Two texts of a class may share its least id; the least digest stays.
    id_, own = fresh_name("_id", docs.columns), fresh_name("_digest", docs.columns)
    first = first.groupBy("class_id", "digest").agg(F.count("*").alias("n"))
    least = F.min(F.struct("digest", "n")).alias("least")
    first = materialize(first.groupBy("class_id").agg(least).select(F.col("class_id").alias(id_), F.col("least.digest").alias(own), "least.n"))
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (digest == F.col(own))
    repeated = first.filter("n > 1").drop("n")
    if repeated.isEmpty():
        return docs.join(first.drop("n"), same, "left_semi")
    # Of repeated rows that differ in other columns the one that is least as JSON stays.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = docs.join(repeated, same).groupBy(id_, own).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return docs.join(first.filter("n = 1").drop("n"), same, "left_semi").unionByName(one)
