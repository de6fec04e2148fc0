"""Toxicity scores: a learned lexicon, matched with misspellings, read in context.

Lexicon. Words and word beginnings (stems) that labelled toxic texts have far more often
than clean ones; the likelihood ratio asked for grows with the vocabulary, so that less
than one term is expected by chance. It is asked for twice, of numbers of texts and of
numbers of different neighbours, as copies of a text repeat all its words. Terms lie in
one trie.

Matching. A word of a text is a Levenshtein automaton whose states are sets of places for
each number of errors. Walking the trie with it finds the nearest term; a branch ends as
soon as no state is left. Terms of four letters or more may have one error, of eight or
more two. A word need only be walked if a piece of a term stands about where the term has
it, which one regular expression tells for all words (of ``k + 1`` pieces one has no
error). Words near a term that clean texts have are no matches.

Context. The words around a match and quotation marks say whether it is said or quoted:
each context word has a log ratio between matches of toxic and of clean texts, learned
from labelled rows; quotation marks count as the prior says until labels say otherwise.

Score. A logistic function of the numbers of matches by kind (0 to 3 or more; the first
counts most), fitted on counts per pattern. Stems and misspellings start from shares of
the weight of whole words, from which labels move them. Lexicon and patterns come from different halves of the labelled
texts, each half judged by the other's lexicon; the final lexicon is that of both.

Only labels of rows that are not held out are learned from, at most about ``sample_rows``
by a hash of their id. Equal texts count once. Scoring covers every row and whole texts.

Edge cases: a null text counts as empty; texts without a match get the base score; with no
labels, or labels of one class, every score is the share of toxic labels (0 without any);
rows of one id are scored by their own text; a null id is never learned from and not held
out; of several labels of one id the greatest counts, null ones do not; repeated rows get
equal scores; an empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import batches, column
from .language_id import held_out
from .tables import materialize, texts

SAMPLE_ROWS = 100_000
#: Letters of a word that may become a term; a longer word is no term.
LONGEST_TERM = 40
STEM_LENGTHS = range(4, 11)
CONTEXT = 6
#: Most that a term may be as frequent in clean texts, as a share of its frequency in toxic ones.
WORD_RATE, STEM_RATE = 0.25, 0.01
#: What quotation marks count for as long as labels say nothing about them.
QUOTED_PRIOR = -2.0
#: A match whose context is at most this counts as quoted.
QUOTATION = -1.0
MOST_COUNTED = 3
KINDS = ["word", "stem", "one error", "two errors", "quoted"]
#: What 0, 1, 2 and more matches of a kind count for.
STEPS = np.array([0.0, 1.0, 1.2, 1.3])
#: Share of a whole word's weight that a kind has before labels say more.
SHARES = [1.0, 1.0, 0.8, 0.4, 0.0]
PENALTY = 0.1
#: Letters of one regular expression that sorts out words before the walk.
LONGEST_FILTER = 5_000
KEEP_WORDS = 200_000
SLICE = 2 << 20
#: One rule for words in Spark, Arrow and Python: letters, digits and signs that stand for letters.
OUTSIDE = r"[^\p{L}\p{N}@$*]+"
INSIDE = r"[\p{L}\p{N}@$*]+"
QUOTES = re.compile(r'"[^"\n]{1,400}"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“\n]{1,400}“|^[ \t]*>[^\n]*', re.M)


def allowance(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Trie:
    """Terms by letters. Every node knows how many errors some term below it may have."""

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem, self.allow = [-1], [-1], [0]
        for term, ends, errors in [(w, self.word, allowance(w)) for w in words] + [(s, self.stem, int(len(s) >= 6)) for s in stems]:
            node = 0
            for c in term:
                self.allow[node] = max(self.allow[node], errors)
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    for x, new in ((self.next, {}), (self.word, -1), (self.stem, -1), (self.allow, 0)):
                        x.append(new)
                node = self.next[node][c]
            self.allow[node] = max(self.allow[node], errors)
            ends[node] = errors

    def nearest(self, word: str) -> tuple[int, bool] | None:
        """Errors of the nearest term and whether it is a stem; None if no term is near enough.

        Bit ``i`` of state ``e`` says that the letters so far fit the first ``i`` of
        ``word`` with ``e`` errors. Whole words win over stems.
        """
        where: dict[str, int] = {}
        for i, c in enumerate(word):
            where[c] = where.get(c, 0) | 1 << i
        size, last = (1 << (len(word) + 1)) - 1, 1 << len(word)
        best = None
        todo = [(0, [((2 << e) - 1) & size for e in range(self.allow[0] + 1)])]
        while todo:
            node, state = todo.pop()
            for errors, place in enumerate(state):
                if place & last and errors <= self.word[node]:
                    best = min(best or (9, False), (errors, False))
                if place & ~1 and errors <= self.stem[node]:
                    best = min(best or (9, False), (errors, True))
            for c, child in self.next[node].items():
                hit = where.get(c, 0)
                step, before, fresh = [], 0, 0
                for errors in range(self.allow[child] + 1):
                    old = state[errors]
                    # A match, or with one error more: c is too much, wrong, or a letter of the word is.
                    new = ((old & hit) << 1) | before | (before << 1) | (fresh << 1)
                    before, fresh = old, new & size
                    step.append(fresh)
                if any(step):
                    todo.append((child, step))
        return best


def _pieces(words: list[str], stems: list[str]) -> list[str]:
    """Regular expressions, one of which every word near a term fits."""
    parts = set()
    for term, errors, whole in [(w, allowance(w), True) for w in words] + [(s, int(len(s) >= 6), False) for s in stems]:
        cuts = [len(term) * i // (errors + 1) for i in range(errors + 2)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            after = len(term) - b
            rest = f".{{{max(0, after - errors)},{after + errors}}}$" if whole else ""
            parts.add(f"^.{{{max(0, a - errors)},{a + errors}}}{re.escape(term[a:b])}{rest}")
    out, size = [[]], 0
    for part in sorted(parts):
        if size + len(part) > LONGEST_FILTER:
            out.append([])
            size = 0
        out[-1].append(part)
        size += len(part) + 1
    return ["|".join(x) for x in out if x]


@dataclass
class Lexicon:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    #: Words near a term that are none.
    cleared: frozenset[str] = frozenset()

    def matcher(self):
        """A function from an Arrow array of words to their kinds: 0 or 1 + place in ``KINDS``."""
        trie, filters, seen = Trie(self.words, self.stems), _pieces(self.words, self.stems), {}

        def kind(word: str) -> int:
            found = seen.get(word)
            if found is None:
                near = trie.nearest(word) if word not in self.cleared else None
                found = 0 if near is None else (2 if near[1] else 1) if near[0] == 0 else 2 + near[0]
                if len(seen) > KEEP_WORDS:
                    seen.clear()
                seen[word] = found
            return found

        def kinds(words: pa.Array) -> np.ndarray:
            out = np.zeros(len(words), np.int8)
            if not len(words) or not (self.words or self.stems):
                return out
            able = np.zeros(len(words), bool)
            for pattern in filters:
                able |= pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(able)
            out[at] = [kind(w) for w in words.take(pa.array(at)).to_pylist()]
            return out

        return kinds


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of a slice, the word at every place, and where texts start."""
    text = pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    pieces = pc.ascii_split_whitespace(pc.utf8_trim(pc.replace_substring_regex(text, OUTSIDE, " "), " "))
    bounds = np.asarray(pieces.offsets)
    table = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds, at = bounds - bounds[0], np.asarray(table.indices)
    # The split of an empty text is one empty word.
    real = np.asarray(pc.binary_length(table.dictionary)) > 0 if len(table.dictionary) else np.zeros(0, bool)
    keep = real[at]
    return table.dictionary, at[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def quoted_places(text: str, places: list[int]) -> list[bool]:
    """Whether the words at ``places`` (ascending numbers of words) stand in quotation marks or a quoted line."""
    spans = [m.span() for m in QUOTES.finditer(text)]
    if not spans or not places:
        return [False] * len(places)
    import regex

    out, wanted, span = [], iter(places), 0
    place = next(wanted)
    for number, m in enumerate(regex.finditer(INSIDE, text.lower())):
        if number == place:
            while span < len(spans) and spans[span][1] <= m.start():
                span += 1
            out.append(span < len(spans) and spans[span][0] <= m.start())
            place = next(wanted, None)
            if place is None:
                break
    return out + [False] * (len(places) - len(out))


def matches(rows: pa.RecordBatch, kinds):
    """Per text with a match ``(row, [(kind, quoted, context words)])``."""
    text = column(rows, "text")
    distinct, at, first = tokens(text)
    code = kinds(distinct)
    hits = np.flatnonzero(code[at]) if len(at) else np.zeros(0, np.int64)
    if not len(hits):
        return
    owner = np.searchsorted(first, hits, "right") - 1
    for row in np.unique(owner).tolist():
        own = hits[np.searchsorted(owner, row) : np.searchsorted(owner, row, "right")]
        low, high = int(first[row]), int(first[row + 1])
        quoted = quoted_places(text[row].as_py(), (own - low).tolist())
        found = []
        for place, q in zip(own.tolist(), quoted):
            around = np.r_[max(low, place - CONTEXT) : place, place + 1 : min(high, place + CONTEXT + 1)]
            found.append((int(code[at[place]]), q, distinct.take(pa.array(at[around])).to_pylist()))
        yield row, found


@dataclass
class Model:
    lexicon: Lexicon
    cues: dict[str, float]
    quoted: float
    #: One weight per kind, and the intercept last.
    weights: np.ndarray

    def score(self, found: list[tuple[int, bool, list[str]]]) -> float:
        counts = np.zeros(len(KINDS), int)
        for kind, quoted, words in found:
            context = sum(self.cues.get(w, 0.0) for w in words) + (self.quoted if quoted else 0.0)
            counts[len(KINDS) - 1 if context <= QUOTATION else kind - 1] += 1
        x = float(STEPS[np.minimum(counts, MOST_COUNTED)] @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def evidence(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Half the likelihood ratio of ``a`` toxic and ``b`` clean texts against their shares; 0 if not on the toxic side."""
    share = toxic / max(toxic + clean, 1)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((a + b) * p))).otherwise(0.0)
    if not 0 < share < 1:
        return F.lit(0.0)
    return F.when(a > (a + b) * share, part(a, share) + part(b, 1 - share)).otherwise(0.0)


def _strong(found: DataFrame, toxic: int, clean: int, size: int, pure: float) -> DataFrame:
    """Rows with more evidence than chance gives among ``size``, and a clean rate of at most ``pure`` times the toxic one."""
    rare = F.col("b") * toxic <= pure * F.col("a") * clean
    return found.filter(rare & (evidence(F.col("a"), F.col("b"), toxic, clean) >= math.log(max(size, 1)) + 1))


def _candidates(vocabulary: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str], int, int]:
    """Words and stems that stand out by their numbers of texts, and among how many they do."""
    own = vocabulary.filter("a + b > 0")
    longer = own.filter(F.length("word") > STEM_LENGTHS[0])
    lengths = F.sequence(F.lit(STEM_LENGTHS[0]), F.least(F.lit(STEM_LENGTHS[-1]), F.length("word") - 1))
    stems = longer.select(F.explode(F.transform(lengths, lambda n: F.substr("word", F.lit(1), n))).alias("stem"), "a", "b")
    stems = materialize(stems.groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("words")))
    n_words, n_stems = own.count(), stems.count()
    words = [r.word for r in _strong(own, toxic, clean, n_words, WORD_RATE).filter(F.length("word") >= 3).select("word").collect()]
    stems = [r.stem for r in _strong(stems, toxic, clean, n_stems, STEM_RATE).filter("words >= 3").select("stem").collect()]
    return words, stems, n_words, n_stems


def _contexts(learned: DataFrame, words: list[str], stems: list[str]) -> DataFrame:
    """``term, is_stem, half, toxic, side, beside``: the different neighbours that candidates have.

    Copies of one text repeat a word beside the same words, so they count once.
    """
    known, begins = pa.array(words, pa.large_string()), pa.array(stems, pa.large_string())

    def find(frames):
        for batch in frames:
            for rows, _, _ in batches(iter([batch]), "text", SLICE):
                distinct, at, first = tokens(column(rows, "text"))
                half, toxic = (column(rows, c).to_numpy() for c in ("half", "toxic"))
                text = np.repeat(np.arange(rows.num_rows), np.diff(first))
                out = []
                for is_stem, length in [(False, 0), *((True, n) for n in STEM_LENGTHS)]:
                    cells = pc.utf8_slice_codeunits(distinct, 0, length) if is_stem else distinct
                    where = pc.index_in(cells, value_set=begins if is_stem else known).fill_null(-1).to_numpy(zero_copy_only=False)
                    if is_stem:
                        where = np.where(pc.utf8_length(distinct).to_numpy() > length, where, -1)
                    hits = np.flatnonzero(where[at] >= 0) if len(at) else np.zeros(0, np.int64)
                    for side in (-1, 1):
                        by = np.clip(hits + side, 0, max(len(at) - 1, 0))
                        for place, near in zip(hits.tolist(), by.tolist()):
                            beside = distinct[int(at[near])].as_py() if near != place and text[near] == text[place] else ""
                            term = (stems if is_stem else words)[int(where[at[place]])]
                            out.append((term, is_stem, int(half[text[place]]), int(toxic[text[place]]), side, beside))
                yield pa.RecordBatch.from_pylist([dict(zip(CONTEXT_ROW.names, x)) for x in out], CONTEXT_ROW)

    found = learned.select("half", "toxic", "text").mapInArrow(find, "term string, is_stem boolean, half int, toxic int, side int, beside string")
    return materialize(found.distinct())


def _terms(contexts: DataFrame, halves: list[int], size: dict, n_words: int, n_stems: int) -> Lexicon:
    """The candidates that stand out by their numbers of different contexts, too."""
    toxic, clean = (sum(size.get((h, t), 0) for h in halves) for t in (1, 0))
    own = contexts.filter(F.col("half").isin(halves)).select("term", "is_stem", "toxic", "side", "beside").distinct()
    own = own.groupBy("term", "is_stem", "side").agg(
        F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")
    )
    # The side with fewer different neighbours counts.
    own = own.groupBy("term", "is_stem").agg(F.min(F.struct("a", "b")).alias("x")).select("term", "is_stem", "x.*")
    strong = {r.term: r.a for r in _strong(own.filter("is_stem"), toxic, clean, n_stems, STEM_RATE).select("term", "a").collect()}
    # Of beginnings of one another the shortest, but as long as it can be without losing matches.
    whole = {s for s, a in strong.items() if not any(t.startswith(s) and t != s and n >= 0.95 * a for t, n in strong.items())}
    stems = sorted(s for s in whole if not any(s[:n] in whole for n in range(STEM_LENGTHS[0], len(s))))
    words = [r.term for r in _strong(own.filter("not is_stem"), toxic, clean, n_words, WORD_RATE).select("term").collect()]
    return Lexicon(sorted(w for w in words if not any(w.startswith(s) for s in stems)), stems)


def _cleared(vocabulary: DataFrame, clean: str, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean texts that are near a term and none."""

    def near(frames):
        kinds = lexicon.matcher()
        for batch in frames:
            words = column(batch, "word").cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([words.filter(pa.array(kinds(words) > 1)).cast(pa.string())], ["word"])

    return frozenset(r.word for r in vocabulary.filter(f"{clean} > 0").select("word").mapInArrow(near, "word string").collect())


def fit(patterns: list[tuple[tuple[int, ...], int, int]], penalty: float = PENALTY) -> np.ndarray:
    """Logistic weights by Newton steps from counts ``(pattern, toxic, clean)``; the intercept is last and free."""
    toxic, clean = sum(p[1] for p in patterns), sum(p[2] for p in patterns)
    weights = np.zeros(len(KINDS) + 1)
    if not toxic or not clean:
        weights[-1] = 700.0 if toxic else -800.0
        return weights
    # The first column is the weight that all kinds share, the others are what a kind differs by.
    share = np.eye(len(KINDS) + 1)
    share[:-1, 0] = SHARES
    x = np.array([[*STEPS[list(p[0])], 1] for p in patterns], float) @ share
    y, n = np.array([p[1] for p in patterns], float), np.array([p[1] + p[2] for p in patterns], float)
    ridge = np.diag([penalty] * len(KINDS) + [1e-9])
    weights[-1] = math.log(toxic / clean)
    loss = lambda w: float((n * np.logaddexp(0, x @ w) - y * (x @ w)).sum() + w @ ridge @ w / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        slope = x.T @ (y - n * p) - ridge @ weights
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, slope)
        size = 1.0
        while size > 1e-6 and loss(weights + size * step) > loss(weights):
            size /= 2
        weights = weights + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return share @ weights


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, mark: str = "toxic") -> Model:
    """Learns from the texts of ``docs`` whose ids have a label in ``labels`` and are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(mark).cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()
    )
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    # At most about sample_rows ids and labels: a broadcast of known size.
    known = materialize(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    rows = texts(docs).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = rows.select("doc_id", "key").join(F.broadcast(known), "doc_id").groupBy("doc_id", "key").agg(
        F.max("toxic").alias("toxic"), F.count("*").alias("rows")
    )
    one = own.groupBy("key").agg(F.min(F.struct("doc_id", "rows")).alias("least"), F.max("toxic").alias("toxic"))
    half = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2)).cast("int").alias("half")
    one = materialize(one.select("key", "least.*", "toxic", half))
    size = {(r.half, r.toxic): r["count"] for r in one.groupBy("half", "toxic").count().collect()}
    learned = rows.join(F.broadcast(one), ["doc_id", "key"])
    if not one.filter("rows > 1").isEmpty():
        learned = learned.dropDuplicates(["key"])
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({INSIDE})")))
    names = {(h, t): f"{'ab'[t == 0]}{h}" for h in (0, 1) for t in (0, 1)}
    words = learned.select("half", "toxic", F.explode(found).alias("word"))
    vocabulary = materialize(
        words.filter(F.length("word") <= LONGEST_TERM)
        .groupBy("word")
        .agg(*[F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(n) for (h, t), n in names.items()])
        .withColumns({"a": F.col("a0") + F.col("a1"), "b": F.col("b0") + F.col("b1")})
    )
    toxic, clean = (sum(size.get((h, t), 0) for h in (0, 1)) for t in (1, 0))
    candidates = _candidates(vocabulary.select("word", "a", "b"), toxic, clean)
    contexts = _contexts(learned, *candidates[:2])
    lexicons = []
    for h in ("0", "1", ""):
        own = _terms(contexts, [int(h)] if h else [0, 1], size, *candidates[2:])
        lexicons.append(Lexicon(own.words, own.stems, _cleared(vocabulary, f"b{h}", own)))

    def judge(frames):
        # Each half is matched with the other's lexicon.
        other = [lexicons[1].matcher(), lexicons[0].matcher()]
        for batch in frames:
            for half in (0, 1):
                mine = batch.filter(pc.equal(column(batch, "half"), half))
                for rows_, _, _ in batches(iter([mine]), "text", SLICE):
                    key, toxic = column(rows_, "key").to_pylist(), column(rows_, "toxic").to_pylist()
                    out = [(key[r], toxic[r], kind, quoted, words) for r, all_ in matches(rows_, other[half]) for kind, quoted, words in all_]
                    yield pa.RecordBatch.from_pylist([dict(zip(HIT.names, x)) for x in out], HIT)

    hits = materialize(learned.select("key", "toxic", "half", "text").mapInArrow(judge, "key long, toxic int, kind int, quoted boolean, words array<string>"))
    total = {r.toxic: r["count"] for r in hits.groupBy("toxic").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    around = hits.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")
    )
    ratio = lambda a, b: F.log((a + 0.5) / (toxic + 1.0) / ((b + 0.5) / (clean + 1.0)))
    cues, quoted = {}, QUOTED_PRIOR
    if toxic and clean:
        limit = math.log(around.count() + 1) + 1
        sure = F.greatest(
            evidence(F.col("a"), F.col("b"), toxic, clean), evidence(F.col("b"), F.col("a"), clean, toxic)
        )
        cues = {r.word: max(-2.0, min(2.0, r.x)) for r in around.filter(sure >= limit).select("word", ratio(F.col("a"), F.col("b")).alias("x")).collect()}
        marked = {r.toxic: r["count"] for r in hits.filter("quoted").groupBy("toxic").count().collect()}
        a, b = marked.get(1, 0), marked.get(0, 0)
        if a + b >= 10:
            quoted = math.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
    weight = F.lit(0.0)
    if cues:
        table = F.create_map(*[F.lit(x) for pair in sorted(cues.items()) for x in pair])
        weight = F.aggregate("words", F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    context = weight + F.when(F.col("quoted"), F.lit(quoted)).otherwise(0.0)
    kind = F.when(context <= QUOTATION, F.lit(len(KINDS))).otherwise(F.col("kind"))
    counts = [F.least(F.count_if(F.col("kind") == k + 1), F.lit(MOST_COUNTED)).cast("int").alias(f"n{k}") for k in range(len(KINDS))]
    per_text = hits.select("key", "toxic", kind.alias("kind")).groupBy("key", "toxic").agg(*counts)
    names = [f"n{k}" for k in range(len(KINDS))]
    # At most (MOST_COUNTED + 1) ** len(KINDS) patterns.
    rows_ = per_text.groupBy(*names).agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).collect()
    patterns = [(tuple(r[n] for n in names), r.a, r.n - r.a) for r in rows_]
    rest = [sum(size.get((h, t), 0) for h in (0, 1)) for t in (1, 0)]
    patterns.append(((0,) * len(KINDS), rest[0] - sum(p[1] for p in patterns), rest[1] - sum(p[2] for p in patterns)))
    return Model(lexicons[2], cues, quoted, fit(patterns))


CONTEXT_ROW = pa.schema([("term", pa.string()), ("is_stem", pa.bool_()), ("half", pa.int32()), ("toxic", pa.int32()), ("side", pa.int32()), ("beside", pa.string())])
HIT = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("kind", pa.int32()), ("quoted", pa.bool_()), ("words", pa.list_(pa.string()))])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(frames):
        own = shared.value
        kinds, base = own.lexicon.matcher(), own.score([])
        for rows, _, _ in batches(frames, "text", SLICE):
            out = np.full(rows.num_rows, base)
            for row, found in matches(rows, kinds):
                out[row] = own.score(found)
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(out)], ["doc_id", "score"])
        pa.default_memory_pool().release_unused()

    return texts(docs).mapInArrow(judge, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, at: float = 0.7, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    found = score(docs, train(docs, labels, **options))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
