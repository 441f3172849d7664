"""SentencePiece encoding and decoding by a lattice of each word.

A text is cut into words (a run of word marks and what follows it; no piece of the model
may cross such a border).  A word's substrings up to the longest piece are looked up in the
piece table; those found are the edges of its lattice, and a fold takes the pieces from
them.  For unigram models the fold is Viterbi.  A BPE model's segmentation is not the best
path of any sum of scores, so for those the fold merges the best-scored neighbouring pair,
leftmost first, until none is left.  Characters without a piece become byte pieces.

``encode_words`` does this as relations: substrings exploded, joined by equality to the
piece table, grouped by word, folded by a higher-order aggregate.  To bring its result back
to the texts every occurrence of a word has to be shuffled, so ``encode`` builds the same
lattice inside each Arrow batch, for all its words that the task does not hold yet at once: nothing
is shuffled, and memory is bounded by the batch, the longest word, ``KEPT`` and ``SLICE``.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
LONG = 200
#: A Python process forgets its words when it holds more than this, and encodes texts of so many characters at once.
KEPT = 1 << 19
SLICE = 1 << 22


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """``piece, id, score`` of the ordinary pieces; its size is the vocabulary's."""
    return spark.createDataFrame([(p, i, s) for p, i, s in _pieces(model)[0]], "piece string, id int, score double")


def _pieces(model: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    first = sp.piece_to_id("<0x00>")
    if any(MARK in p.lstrip(MARK) for p, _, _ in plain):
        raise ValueError("a piece crosses a word border")
    return plain, (first if sp.is_byte(first) else None), sp.unk_id()


def _best_merge(edges: str = "edges") -> str:
    """One step of the BPE fold over ``st``, an array of pieces."""
    pairs = f"transform(sequence(1, size(st) - 1), i -> struct(coalesce({edges}[concat(st[i - 1], st[i])].score, double('-Infinity')) AS score, -i AS at))"
    best = f"array_max({pairs})"
    merged = "concat(slice(st, 1, -b.at - 1), array(concat(st[-b.at - 1], st[-b.at])), slice(st, -b.at + 2, size(st)))"
    return f"if(size(st) < 2, st, transform(array({best}), b -> if(b.score = double('-Infinity'), st, {merged}))[0])"


def encode_words(words: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """``word, ids`` for distinct ``word`` rows.  ``kind`` is bpe or unigram."""
    spark = words.sparkSession
    plain, byte0, unk = _pieces(model)
    longest = max(len(p) for p, _, _ in plain)
    pieces = F.broadcast(piece_table(spark, model))  # bounded: one row a vocabulary entry
    words = words.withColumn("chars", F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))).withColumn("n", F.size("chars"))
    starts = "sequence(1, n)"
    subs = f"explode(flatten(transform({starts}, s -> transform(sequence(1, least({longest}, n - s + 1)), l -> array_join(slice(chars, s, l), ''))))) AS piece"
    if kind == "unigram":
        subs = f"explode(flatten(transform({starts}, s -> transform(sequence(1, least({longest}, n - s + 1)), l -> struct(s AS s, s + l AS e, array_join(slice(chars, s, l), '') AS piece))))) AS x"
        edges = words.selectExpr("word", "chars", subs).select("word", "chars", "x.*").join(pieces, "piece")
        edges = edges.groupBy("word", "chars").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))
        lost = min(s for _, _, s in plain) - 10.0
        reach = "filter(edges, x -> x.e = i + 1)"
        step = f"transform({reach}, x -> struct(get(st, x.s - 1).score + x.score AS score, -x.s AS back, concat(get(st, x.s - 1).ids, array(x.id)) AS ids))"
        single = f"if(exists(edges, x -> x.s = i AND x.e = i + 1), array(), array(struct(get(st, i - 1).score + {lost}D AS score, -i AS back, concat(get(st, i - 1).ids, array(-i)) AS ids)))"
        start = "array(struct(0D AS score, 0 AS back, cast(array() AS array<int>) AS ids))"
        fold = f"aggregate(sequence(1, size(chars)), {start}, (st, i) -> concat(st, array(array_max(concat({step}, {single})))), st -> element_at(st, -1).ids)"
        back = _byte_ids("chars[-p - 1]", byte0, unk)
        full = words.select("word", "chars").join(edges.select("word", "edges"), "word", "left").withColumn("edges", F.expr("coalesce(edges, cast(array() AS array<struct<s:int,e:int,id:int,score:double>>))"))
        return full.selectExpr("word", f"flatten(transform({fold}, p -> if(p >= 0, array(p), {back}))) AS ids")
    edges = words.selectExpr("word", subs).join(pieces, "piece")
    edges = edges.groupBy("word").agg(F.map_from_entries(F.collect_set(F.struct("piece", F.struct("id", "score").alias("v")))).alias("edges"))
    full = words.join(edges, "word", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(map() AS map<string, struct<id:int,score:double>>)")))
    fold = f"aggregate(sequence(1, n), chars, (st, i) -> {_best_merge()})"
    ids = f"flatten(transform({fold}, p -> if(map_contains_key(edges, p), array(edges[p].id), {_byte_ids('p', byte0, unk)})))"
    short = full.where(F.col("n") <= LONG).selectExpr("word", f"{ids} AS ids")
    far = full.where(F.col("n") > LONG).select("word").mapInArrow(_long_words(Lattice(model)), "word string, ids array<int>")
    return short.unionByName(far)


def _byte_ids(piece: str, byte0: int | None, unk: int) -> str:
    if byte0 is None:
        return f"array({unk})"
    hexed = f"hex(encode({piece}, 'UTF-8'))"
    return f"transform(sequence(1, length({hexed}) div 2), k -> {byte0} + cast(conv(substring({hexed}, 2 * k - 1, 2), 16, 10) AS int))"


def _long_words(lattice: Lattice):
    """Words whose length would make the fold over arrays quadratic."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words = b.column("word")
            ids = [np.frombuffer(lattice.encode_word(w), "<i4") for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


class Lattice:
    """The piece table of a model and the folds over a word's edges."""

    def __init__(self, model: str, kind: str = "bpe") -> None:
        plain, self.byte0, self.unk = _pieces(model)
        self.kind = kind
        self.table = {p: (i, s) for p, i, s in plain}
        self.longest = max(map(len, self.table))
        self.reach: dict[str, int] = {}  # by the first two characters: the longest piece that starts with them
        for p in self.table:
            self.reach[p[:2]] = max(self.reach.get(p[:2], 1), len(p))
        self.lost = min(s for _, s in self.table.values()) - 10.0

    def edges(self, word: str) -> dict[tuple[int, int], tuple[int, float]]:
        """``(start, end) -> (id, score)`` of the substrings that are pieces."""
        find, reach, n = self.table.get, self.reach.get, len(word)
        return {(s, e): hit for s in range(n) for e in range(s + 1, min(n, s + reach(word[s : s + 2], 1)) + 1) if (hit := find(word[s:e]))}

    def encode_word(self, word: str) -> bytes:
        """The word's ids as little-endian 32-bit integers."""
        edges = self.edges(word)
        out: list[int] = []
        for span in (self._merge if self.kind == "bpe" else self._viterbi)(len(word), edges):
            if hit := edges.get(span):
                out.append(hit[0])
            elif self.byte0 is None:
                out.append(self.unk)
            else:
                out += [self.byte0 + b for b in word[slice(*span)].encode()]
        return np.array(out, "<i4").tobytes()

    def _merge(self, n: int, edges: dict) -> list[tuple[int, int]]:
        """Spans left when the best edge over two neighbours, leftmost first, is merged again and again."""
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (hit := edges.get((i, end[end[i]]))):
                heapq.heappush(heap, (-hit[1], i, end[i], end[end[i]]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, e = heapq.heappop(heap)
            if end[i] != j or end[j] != e:
                continue  # one of the two is part of another piece by now
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
            offer(i)
            offer(before[i])
        spans, i = [], 0
        while i < n:
            spans.append((i, end[i]))
            i = end[i]
        return spans

    def _viterbi(self, n: int, edges: dict) -> list[tuple[int, int]]:
        """Spans of the best path; of equal paths the one whose last edge starts first. Single characters without an edge cost ``lost``."""
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                hit = edges.get((s, e))
                step = hit[1] if hit else self.lost if s == e - 1 else -math.inf
                if score[s] + step > score[e]:
                    score[e], back[e] = score[s] + step, s
        spans, e = [], n
        while e > 0:
            spans.append((back[e], e))
            e = back[e]
        return spans[::-1]


class Tries:
    """The same lattice and fold for many words at once; BPE models only.

    Substrings are matched from every start in step, one character a round, through a trie
    whose edges are sorted exact numbers ``node * 2**21 + code point``.
    """

    def __init__(self, lattice: Lattice) -> None:
        nodes: dict[str, int] = {"": 0}
        for p in lattice.table:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        steps = sorted((nodes[x[:-1]] << 21 | ord(x[-1]), n) for x, n in nodes.items() if x)
        self.keys, self.child = (np.array(c, np.int64) for c in zip(*steps))
        none = len(lattice.table)
        self.piece = np.full(len(nodes), none, np.int32)
        for row, p in enumerate(lattice.table):
            self.piece[nodes[p]] = row
        self.ids = np.array([i for i, _ in lattice.table.values()] + [0], "<i4")
        order = np.unique([-x for _, x in lattice.table.values()], return_inverse=True)[1]
        self.rank = np.append(order, none).astype(np.int32)  # equal scores, equal ranks; the last entry is no piece
        self.none, self.lattice = none, lattice

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        out, by_size = {}, {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for n, group in by_size.items():
            if n > LONG // 4:
                out |= {w: self.lattice.encode_word(w) for w in group}
                continue
            room = max(1, (1 << 21) // (n + 1) ** 2)
            for i in range(0, len(group), room):
                out |= self._same_size(group[i : i + room], n)
        return out

    def _edges(self, words: list[str], n: int) -> np.ndarray:
        """``[word, start, end] -> piece``, or ``none``."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        edges = np.full((len(words), n + 1, n + 1), self.none, np.int32)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for k in range(self.lattice.longest):
            inside = at % n + k < n
            at, key = at[inside], node[inside] << 21 | codes[at[inside] + k]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[pos] == key
            at, node = at[hit], self.child[pos[hit]]
            if not len(at):
                break
            edges[at // n, at % n, at % n + k + 1] = self.piece[node]
        return edges

    def _same_size(self, words: list[str], n: int) -> dict[str, bytes]:
        edges = self._edges(words, n)
        end = np.tile(np.arange(1, n + 2, dtype=np.int64), (len(words), 1))  # of the span from each start; 0: no span starts here
        end[:, n] = 0
        live, start = np.arange(len(words)), np.arange(n)
        while len(live):
            e1 = end[live, :n]
            e2 = np.take_along_axis(end[live], e1, 1)
            rank = np.where(e1 > 0, self.rank[edges[live[:, None], start, e2]], self.none)
            best = rank.argmin(1)  # the leftmost of equal ones
            one = np.flatnonzero(rank[np.arange(len(live)), best] < self.none)
            live, best, e1, e2 = live[one], best[one], e1[one, best[one]], e2[one, best[one]]
            end[live, best], end[live, e1] = e2, 0
        w, s = np.nonzero(end[:, :n])
        piece = edges[w, s, end[w, s]]
        raw, ends = self.ids[piece].tobytes(), np.cumsum(np.bincount(w, minlength=len(words))) * 4
        odd = set(w[piece == self.none].tolist())  # words with characters that are no piece
        out, a = {}, 0
        for i, (word, b) in enumerate(zip(words, ends.tolist())):
            out[word] = self.lattice.encode_word(word) if i in odd else raw[a:b]
            a = b
        return out


def encode(docs: DataFrame, model: str, kind: str = "bpe") -> DataFrame:
    """``doc_id, ids`` per row of ``docs(doc_id, text)``.

    Null and empty texts have no ids.  Repeated rows and null ids are rows like any other.
    Other columns are ignored.
    """
    lattice = Lattice(model, kind)
    many = Tries(lattice).encode_words if kind == "bpe" else lambda words: {w: lattice.encode_word(w) for w in words}

    def run(batches):
        import pyarrow as pa

        cut = re.compile(f"{MARK}+[^{MARK}]*").findall
        known: dict[str, bytes] = {}

        def ids_of(cuts: list[list[str]]) -> pa.Array:
            if len(known) > KEPT:
                known.clear()
            known.update(many(list(set().union(*cuts) - known.keys())))
            found = [b"".join(map(known.__getitem__, words)) for words in cuts]
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))

        for batch in batches:
            first, held, cuts = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                cuts.append(cut(MARK + text.replace(" ", MARK)) if text else [])
                held += len(text)
                if held >= SLICE or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(cuts)), ids_of(cuts)], names=["doc_id", "ids"])
                    first, held, cuts = i + 1, 0, []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` and the columns ``keep`` of rows ``doc_id, ids``: pieces are looked up by id, their bytes put together, marks become spaces.

    Null and empty ids give an empty text; ids without a piece (control, unknown) give nothing.
    """
    plain, byte0, _ = _pieces(model)
    raw = {i: p.encode() for p, i, _ in plain}
    if byte0 is not None:
        raw |= {byte0 + b: bytes([b]) for b in range(256)}
    top = max(raw, default=0) + 1  # the row of ids without a piece
    flat = np.frombuffer(b"".join(raw.get(i, b"") for i in range(top)), np.uint8)
    ends = np.cumsum([0] + [len(raw.get(i, b"")) for i in range(top)] + [0])

    def text_of(ids) -> str:
        x = ids.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        x[(x < 0) | (x > top)] = top
        size = ends[x + 1] - ends[x]
        at = np.cumsum(size)
        return flat[np.repeat(ends[x + 1] - at, size) + np.arange(at[-1])].tobytes().decode(errors="replace").replace(MARK, " ")[1:]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, len(batch), 256):
                rows = batch.slice(i, 256)
                texts = [text_of(ids) if ids.is_valid and len(ids) else "" for ids in rows.column("ids")]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string()), *map(rows.column, keep)], names=["doc_id", "text", *keep])

    src = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", *keep)
    kept = "".join(f", {src.schema[c].name} {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, "doc_id long, text string" + kept)
