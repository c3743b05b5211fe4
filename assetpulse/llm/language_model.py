"""Hierarchical Pitman-Yor language model over word pairs.

Every word (and the end token, which also begins a text) is a context
restaurant of its own. Context restaurants share one parent,
the restaurant of single words, over a uniform base of the known words and one
unknown word. Customers are training tokens; a table of a context sends one
customer to the parent. Seating follows the Chinese-restaurant process and is
resampled by Gibbs sweeps: all customers of a dish are seated anew given the
other dishes' tables and the parent's prediction. Tokens are scored by the
predictive probability averaged over ``SAMPLES`` seatings.

A word is frequent when it makes up at least ``1 / 2**17`` of the training
tokens, so there are at most 2**17 of them by arithmetic, and what is sent to
all tasks (their counts and tables) is bounded by a few MB. The totals of all
other contexts are exchanged by context between the tasks that hold their pairs.
The split decides where a total is kept, not how a context is modelled.
Everything else is counted, seated and scored where it was dealt to:

1. Single words are counted over all documents, dealt by word.
2. Texts are read in chunks. A chunk's (context, word) occurrences are
   aggregated by document and dealt by word; a frequent word is cut by context
   into slices in proportion to its count, so no word's occurrences meet in one
   task. Frequent words have known counts here: their share of a document's base
   score and of its known tokens is summed at once and not sent on.
3. The tasks sum the chunks' counts. A sweep seats all pairs and returns the
   tables of the frequent contexts and words to the driver. Those of the other
   contexts go to the context's place, a range of hashes; each place answers every
   task with the sums of the contexts it asked for, and that answer starts the
   task's next sweep. The pairs themselves stay in a folder for each task.
4. After the sweeps each task scores the occurrences it holds; a chunk's partial
   sums by document come back together.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetpulse.llm import textscan, warc
from assetpulse.llm.quality import remainder
from assetpulse.llm.shared import drop, materialise, scratch

#: A word is frequent from this share of the training tokens on.
FREQUENT = 2.0**-17
CHUNK_TOKENS = 3 << 18
#: Tokens for each of the tasks that count, seat and score.
TASK_TOKENS = 1 << 20
#: A frequent word has a slice for each 1 / SLICES of a task's tokens.
SLICES = 128
#: Tasks for each of the places where the totals of the other contexts are summed.
PLACE_TASKS = 8
#: Steps of the partial sums by task and document, 2 ** -bits: of the base score and of the model's.
BASE_BITS, SCORE_BITS = 30, 20
SWEEPS = 2
SAMPLES = 4
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
#: The end token's code; a word that hashed to it takes the next code.
END = np.uint64(0)
#: Rows of pairs and sweeps, kind 0: a task's pairs and sums; 1: a chunk's documents; 2: what a task asks a place.
ROWS = "part long, kind int, place long, blob binary, sums binary"

_U = np.uint64


def _zip(x) -> bytes:
    """A tuple or dict of arrays, compressed. Wide whole numbers go as byte planes, which compress far better."""
    import zstandard

    def laid(v):
        return _Planes(v) if isinstance(v, np.ndarray) and v.dtype.kind in "iu" and v.itemsize > 1 else v

    x = {k: laid(v) for k, v in x.items()} if isinstance(x, dict) else tuple(laid(v) for v in x)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def _unzip(raw: bytes):
    import zstandard

    x = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    back = lambda v: v.array() if isinstance(v, _Planes) else v
    return {k: back(v) for k, v in x.items()} if isinstance(x, dict) else tuple(back(v) for v in x)


class _Planes:
    """A whole-number array with all first bytes first, then all second bytes, and so on."""

    def __init__(self, x: np.ndarray):
        self.dtype, self.n = x.dtype.str, len(x)
        self.bytes = np.ascontiguousarray(x).view(np.uint8).reshape(self.n, x.itemsize).T.tobytes()

    def array(self) -> np.ndarray:
        width = np.dtype(self.dtype).itemsize
        return np.ascontiguousarray(np.frombuffer(self.bytes, np.uint8).reshape(width, self.n).T).view(self.dtype).reshape(-1)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, wrapping: small where the values rise slowly."""
    return np.diff(x, prepend=x.dtype.type(0))


def _sums(x: np.ndarray) -> np.ndarray:
    """The values that have these differences."""
    return np.cumsum(x, dtype=x.dtype)


def _small(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in their smallest type."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]]:
    """``(document, word, previous word, rows)`` of about ``CHUNK_TOKENS`` tokens; each text ends with ``END``."""
    held, rows, size, docs = [], [], 0, 0
    for part in parts:
        for first, run in textscan.slices(part["text"]):
            doc, _, _, h, _ = textscan.scan(run)
            h = np.maximum(h, _U(1))
            ends = np.searchsorted(doc, np.arange(len(run)), side="right")
            word = np.insert(h, ends, END)
            owner = np.insert(doc, ends, np.arange(len(run)))
            before = np.concatenate(([END], word[:-1]))
            held.append((owner + docs, word, before))
            rows.append(part[["doc_id", "held_out"]].iloc[first : first + len(run)])
            docs, size = docs + len(run), size + len(word)
            if size >= CHUNK_TOKENS:
                yield *(np.concatenate(x) for x in zip(*held, strict=True)), pd.concat(rows)
                held, rows, size, docs = [], [], 0, 0
    if held:
        yield *(np.concatenate(x) for x in zip(*held, strict=True)), pd.concat(rows)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def _parts(keys: np.ndarray, n: int) -> np.ndarray:
    return (textscan.mix(keys) % _U(n)).astype(np.int64)


def _places(contexts: np.ndarray, n: int) -> np.ndarray:
    """The place of each context: ``n`` equal ranges of hashes, so sorted contexts stay in order."""
    return ((contexts >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def seat(customers: np.ndarray, prior: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers one by one.

    ``prior`` is (strength + discount * tables of the restaurant) times the
    parent's probability of the dish. The n-th customer opens a further table
    with probability prior / (prior + n - 1 - discount * tables). Beyond 64
    customers they sit in blocks of a sixteenth, each at its first customer's odds.
    """
    order = np.argsort(-customers, kind="stable")
    c, p = customers[order], prior[order]
    t = (c > 0).astype(np.int64)
    n = 1
    alive = int(np.searchsorted(-c, -1, side="left"))  # dishes with more than one customer
    while alive:
        step = 1 if n < 64 else n // 16
        odds = p[:alive] / (p[:alive] + n - discount * t[:alive])
        if step == 1:
            t[:alive] += rng.random(alive) < odds
        else:
            t[:alive] += rng.binomial(np.minimum(step, c[:alive] - n), odds)
        n += step
        alive = int(np.searchsorted(-c, -n, side="left"))
    out = np.empty_like(t)
    out[order] = t
    return out


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


class _Task:
    """The pairs dealt to one task: frequent words by slices of their contexts, other words with all their contexts."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    @staticmethod
    def build(blobs: list[dict], names: np.ndarray) -> dict:
        """Distinct pairs with training counts, and each occurrence's pair."""
        cat = lambda parts, kind: np.concatenate([x.astype(kind, copy=False) for x in parts])
        word = cat([np.repeat(np.concatenate((names[_sums(b["known"])], _sums(b["words"]))), b["runs"]) for b in blobs], _U)
        few = [_sums(b["few"]) for b in blobs]  # a block's other contexts; its numbers from len(names) on are places in this list
        rare, place = np.unique(cat(few, _U), return_inverse=True)
        starts = np.cumsum([0, *map(len, few)])
        ids = [np.concatenate((np.arange(len(names)), len(names) + place[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        ctx = cat([i[_sums(b["ctx"])] for i, b in zip(ids, blobs, strict=True)], np.int32)
        doc, times = (cat([b[k] for b in blobs], np.uint32) for k in ("doc", "times"))
        learn = cat([np.unpackbits(b["learn"], count=len(b["doc"])) for b in blobs], bool)
        chunk = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b["doc"]) for b in blobs])
        order = np.lexsort((ctx, word))
        w, x = word[order], ctx[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (x[1:] != x[:-1]))) if len(w) else np.empty(0, bool)
        pair = np.empty(len(w), np.int32)
        pair[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        count = np.bincount(pair, times * learn, len(at)).astype(np.int64)
        w, x = w[at], x[at]
        dish = np.cumsum(np.concatenate(([True], w[1:] != w[:-1]))) - 1 if len(w) else np.empty(0, np.int64)
        return {"word": w, "ctx": x, "rare": rare, "count": count, "dish": dish, "chunks": [b["chunk"] for b in blobs],
                "cut": np.searchsorted(chunk, np.arange(len(blobs) + 1)), "pair": pair, "doc": doc, "times": times}

    def totals(self, names: np.ndarray, tables: np.ndarray) -> dict:
        """Sums over the pairs by frequent context and by frequent word, and over all."""
        f = len(names)
        known = _position(names, self.word)
        return {"tables": np.bincount(self.ctx, tables, f)[:f], "parent": np.bincount(known[known >= 0], tables[known >= 0], f),
                "guests": int(tables.sum())}

    def questions(self, number: int, names: np.ndarray, tables: np.ndarray, places: int) -> list[tuple]:
        """``(part, kind, place, blob, sums)`` for each place with other contexts of this task: their customers and tables here."""
        f = len(names)
        here = [np.bincount(self.ctx, x, f + len(self.rare))[f:].astype(np.int64) for x in (self.count, tables)]
        cut = np.searchsorted(_places(self.rare, places), np.arange(places + 1))
        asked = [(p, a, b) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return [(number, 2, p, _zip((_steps(self.rare[a:b]), *(_small(x[a:b]) for x in here))), None)
                for p, a, b in asked or [(number % places, 0, 0)]]  # one place at least: its answer starts the next sweep

    def sample(self, g: dict, tables: np.ndarray | None, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A new seating: the parent's probability of each pair's word, the pairs' tables, the rare words' root tables."""
        known = _position(g["names"], self.word)
        rare = known < 0
        tables = np.minimum(self.count, 1) if tables is None else tables
        dishes = int(self.dish[-1]) + 1 if len(self.dish) else 0
        guests = np.bincount(self.dish, tables, dishes)  # of rare dishes: all their contexts are here
        root = seat(guests.astype(np.int64), np.full(dishes, (ROOT_STRENGTH + g["d0"] * g["root_tables"]) * g["base"]), g["d0"], rng)
        free = (ROOT_STRENGTH + g["d0"] * g["root_tables"]) * g["base"]
        own = (guests - g["d0"] * root)[self.dish]
        if len(g["names"]):
            own[~rare] = (g["parent"] - g["d0"] * g["parent_tables"])[known[~rare]]
        parent = (own + free) / (ROOT_STRENGTH + g["root_customers"])
        drawn = seat(self.count, (STRENGTH + g["d1"] * g["tables"][self.ctx]) * parent, g["d1"], rng)
        first = np.concatenate(([True], self.dish[1:] != self.dish[:-1])) if dishes else np.empty(0, bool)
        return parent, drawn, root[rare[first]] if dishes else root


def _answers(asked: DataFrame, tasks: int) -> DataFrame:
    """``(part, place, blob)``: to each task the customers and tables of the contexts it asked for, summed over all tasks."""
    def answer(part: pd.DataFrame) -> pd.DataFrame:
        got = [_unzip(b) for b in part["blob"]]
        contexts, at = np.unique(np.concatenate([_sums(x[0]) for x in got]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[k] for x in got]), len(contexts)).astype(np.int64) for k in (1, 2)]
        ends = np.cumsum([len(x[0]) for x in got])
        blobs = [_zip(tuple(_small(x[at[e - len(g[0]) : e]]) for x in sums)) for e, g in zip(ends, got, strict=True)]
        return pd.DataFrame({"part": part["part"], "place": part["place"], "blob": blobs})

    told = asked.filter("kind = 2").select("part", "place", "blob").groupBy("place").applyInPandas(answer, "part long, place long, blob binary")
    return told.repartition(tasks, "part")  # few bytes, much work: a partition for each task


def _started(folder: str, part: pd.DataFrame, g: dict) -> tuple[int, _Task, dict]:
    """The task that these answers go to, its pairs, and ``g`` with the totals of all its contexts."""
    import pyarrow.parquet as pq

    number = int(part["part"].iloc[0])
    store, path = warc._filesystem(f"{folder}/file={number}")
    task = _Task(_unzip(pq.read_table(path, columns=["blob"], filesystem=store, partitioning=None)["blob"][0].as_py()))
    told = [_unzip(b) for b in part.sort_values("place")["blob"]]
    customers, tables = (np.concatenate([x[k].astype(np.int64) for x in told]) for k in (0, 1))
    return number, task, g | {"customers": np.concatenate((g["counts"], customers)), "tables": np.concatenate((g["tables"], tables))}


def _position(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each word among the sorted frequent ones, or -1."""
    if not len(names):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
    return np.where(names[at] == words, at, -1)


def _count_words(read: DataFrame, tasks: int) -> DataFrame:
    """``(part, words, counts, n)``: the training counts of every distinct word, dealt by word."""
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc, word, _, rows in _chunks(parts):
            learn = ~rows["held_out"].to_numpy(bool)[doc]
            words, counts = np.unique(word[learn], return_counts=True)
            part = _parts(words, tasks)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(tasks + 1))
            out = [(p, _zip((words[i], counts[i]))) for p in range(tasks) if len(i := order[cut[p] : cut[p + 1]])]
            yield pd.DataFrame(out, columns=["part", "blob"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        got = [_unzip(b) for b in part["blob"]]
        words, counts = _summed(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
        return pd.DataFrame({"n": [int(counts.sum())], "distinct": [len(words)], "blob": [_zip((words, counts))]})

    dealt = read.mapInPandas(emit, "part int, blob binary")
    return materialise(dealt.groupBy("part").applyInPandas(add, "n long, distinct long, blob binary"), "words")


def _heavy(counted: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The words with at least ``least`` training tokens and their counts, in order of the words: at most 1 / FREQUENT."""
    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for blob in part["blob"]:
                words, counts = _unzip(blob)
                yield pd.DataFrame({"blob": [_zip((words[counts >= least], counts[counts >= least]))]})

    got = [_unzip(r[0]) for r in counted.select("blob").mapInPandas(pick, "blob binary").collect()]
    if not got:
        return np.empty(0, _U), np.empty(0, np.int64)
    words, counts = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(words)
    return words[order], counts[order]


def _deal_pairs(read: DataFrame, names: np.ndarray, counts: np.ndarray, logs: np.ndarray, tasks: int) -> DataFrame:
    """``(part, chunk, kind, blob)``: each chunk's occurrences by task, and its documents.

    ``counts`` and ``logs`` are the training counts and base scores of the frequent words ``names``.
    """
    cuts = np.clip(-(-counts * SLICES // TASK_TOKENS), 1, tasks)
    shared = read.sparkSession.sparkContext.broadcast((names, cuts.astype(_U), logs))

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        top, cuts, logs = shared.value
        place = TaskContext.get().partitionId() << 24
        for k, (doc, word, before, rows) in enumerate(_chunks(parts)):
            ctx = _position(top, before)
            few, at = np.unique(before[ctx < 0], return_inverse=True)
            ctx[ctx < 0] = len(top) + at
            ctx = ctx.astype(np.int32)
            rank = _position(top, word)
            heavy = rank >= 0
            piece = np.zeros(len(word), _U)
            piece[heavy] = textscan.mix(before[heavy]) % cuts[rank[heavy]]
            part = _parts(word + piece * _U(0x9E3779B97F4A7C15), tasks)
            order = np.lexsort((ctx, word, ~heavy, part))  # stable: documents stay in order
            p, w, x, d, r = part[order], word[order], ctx[order], doc[order], rank[order]
            new = np.concatenate(([True], (p[1:] != p[:-1]) | (w[1:] != w[:-1]) | (x[1:] != x[:-1]) | (d[1:] != d[:-1])))
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(w))).astype(np.uint32)
            p, w, x, d, r = p[at], w[at], x[at], d[at].astype(np.uint32), r[at].astype(np.int32)
            learn = ~rows["held_out"].to_numpy(bool)
            cut = np.searchsorted(p, np.arange(tasks + 1))
            chunk = place + k
            out = []
            for t, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:  # each word once, with the length of its run; frequent words first, by their place among them
                    run = np.flatnonzero(np.concatenate(([True], w[a + 1 : b] != w[a : b - 1], [True])))
                    words, known = w[a:b][run[:-1]], r[a:b][run[:-1]]
                    other = x[a:b] >= len(top)
                    own, at = np.unique(x[a:b][other], return_inverse=True)
                    named = x[a:b].copy()
                    named[other] = len(top) + at
                    out.append((t, chunk, 0, _zip({"chunk": chunk, "known": _steps(known[known >= 0]), "words": _steps(words[known < 0]),
                                                   "runs": _small(np.diff(run)), "ctx": _steps(named), "few": _steps(few[own - len(top)]),
                                                   "doc": _small(d[a:b]), "times": _small(times[a:b]), "learn": np.packbits(learn[d[a:b]])})))
            ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
            tokens, known = (np.bincount(x, minlength=len(rows)) for x in (doc, doc[heavy]))
            base = np.bincount(doc[heavy], logs[rank[heavy]], len(rows)).astype(float)
            out.append((chunk % tasks, chunk, 1, _zip((ids, ~learn, tokens, known, base))))
            yield pd.DataFrame(out, columns=["part", "chunk", "kind", "blob"])

    return read.mapInPandas(emit, "part int, chunk long, kind int, blob binary")


def score(docs: DataFrame, held_out=None, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` per row of ``docs(doc_id, text)``.

    Learns from the rows that are not ``held_out`` (a boolean column expression;
    by default crc32 of the id mod 7 is 2). Words are ``[^\\x20\\x09-\\x0D]+`` with
    A-Z lower-cased; a null text is empty and still has its end token. Scores are
    log10 probabilities of whole texts. Repeated rows are rows of their own; a
    null id stays null. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held_out = remainder("doc_id", 7) == 2 if held_out is None else held_out
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    # Tasks in proportion to the text: about one for every 6 * TASK_TOKENS bytes.
    size = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    tasks = max(1, -(-size // (6 * TASK_TOKENS)))
    places = -(-tasks // PLACE_TASKS)
    counted = _count_words(read, tasks)
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    names, counts = _heavy(counted, max(1.0, FREQUENT * total))
    frequent = len(names)
    logs = np.log10((counts + 1) / (total + distinct + 1))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        occ = part[part["kind"] == 0].sort_values("chunk")
        listed = part[part["kind"] == 1]
        out = [(chunk, 1, None, blob, None) for chunk, blob in zip(listed["chunk"], listed["blob"], strict=True)]
        if len(occ):
            state = _Task.build([_unzip(b) for b in occ["blob"]], shared_names.value)
            task = _Task(state)
            ones, number = np.minimum(task.count, 1), int(part["part"].iloc[0])
            sums = task.totals(shared_names.value, ones)
            rare = _position(shared_names.value, task.word) < 0
            kinds = np.bincount(task.dish[rare], ones[rare]) if rare.any() else np.empty(0)
            sums |= {"ones": [(task.count == 1).sum(), (kinds == 1).sum()], "twos": [(task.count == 2).sum(), (kinds == 2).sum()],
                     "root": int((kinds > 0).sum())}
            out = [(number, 0, None, _zip(state), _zip(sums)), *task.questions(number, shared_names.value, ones, places), *out]
        return pd.DataFrame(out, columns=["part", "kind", "place", "blob", "sums"]).assign(
            file=[row[0] if row[1] == 0 else -1 for row in out])

    shared_names = spark.sparkContext.broadcast(names)
    dealt = _deal_pairs(read, names, counts, logs, tasks).groupBy("part").applyInPandas(build, f"{ROWS}, file long")
    folder = scratch(spark, "pairs")
    dealt.write.partitionBy("file").parquet(folder)
    states = spark.read.schema(dealt.schema).parquet(folder)

    def add(rows, wanted: tuple[str, ...]) -> dict:
        got: dict = {}
        for row in rows:  # one at a time: a few bounded arrays for each task
            one = _unzip(row[0])
            got = {k: got[k] + np.asarray(one[k]) if k in got else np.asarray(one[k]) for k in wanted}
        return got

    sums = add(states.filter("kind = 0").select("sums").toLocalIterator(), ("tables", "parent", "guests", "ones", "twos", "root"))
    if not sums:
        sums = {"tables": np.zeros(frequent), "parent": np.zeros(frequent), "guests": 0, "ones": np.zeros(2), "twos": np.zeros(2), "root": 0}
    rng = np.random.default_rng(5)
    g = {"names": names, "counts": counts, "base": 1.0 / (distinct + 1), "total": total, "distinct": distinct,
         "d1": _discount(sums["ones"][0], sums["twos"][0]), "d0": _discount(sums["ones"][1], sums["twos"][1])}

    def refresh(sums: dict) -> None:
        g["tables"], g["parent"] = sums["tables"], sums["parent"]
        g["root_customers"] = float(sums["guests"])
        rare_tables = float(sums["root"])
        prior = (ROOT_STRENGTH + g["d0"] * (rare_tables + frequent)) * g["base"]
        g["parent_tables"] = seat(g["parent"].astype(np.int64), np.full(frequent, prior), g["d0"], rng)
        g["root_tables"] = rare_tables + float(g["parent_tables"].sum())

    refresh(sums)

    def sweeper(now, sweep: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            number, task, g = _started(folder, part, now.value)
            own = np.random.default_rng([sweep, number])
            _, tables, _ = task.sample(g, None, own)
            _, tables, root = task.sample(g, tables, own)
            sums = task.totals(g["names"], tables) | {"root": int(root.sum())}
            return pd.DataFrame([(number, 0, None, None, _zip(sums)), *task.questions(number, g["names"], tables, places)],
                                columns=["part", "kind", "place", "blob", "sums"])

        return run

    asked = states
    for sweep in range(sweeps):
        run = sweeper(spark.sparkContext.broadcast(dict(g)), sweep)
        swept = materialise(_answers(asked, tasks).groupBy("part").applyInPandas(run, ROWS), "sweep")
        if asked is not states:
            drop(asked)
        asked = swept
        got = add(swept.filter("kind = 0").select("sums").toLocalIterator(), ("tables", "parent", "guests", "root"))
        if got:
            refresh(got)
    now = spark.sparkContext.broadcast(dict(g))

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        number, task, g = _started(folder, part, now.value)
        own = np.random.default_rng([99, number])
        tables, mean = None, np.zeros(len(task.count))
        for _ in range(samples):
            parent, tables, _ = task.sample(g, tables, own)
            seated = np.maximum(task.count - g["d1"] * tables, 0) + (STRENGTH + g["d1"] * g["tables"][task.ctx]) * parent
            mean += seated / (STRENGTH + g["customers"][task.ctx])
        logp = np.log10(mean / samples)
        rare = _position(g["names"], task.word) < 0
        c = np.bincount(task.dish, task.count, int(task.dish[-1]) + 1)[task.dish]  # read for rare words, which are whole here
        base = np.log10((c + 1) / (g["total"] + g["distinct"] + 1))
        out = []
        for chunk, a, b in zip(task.chunks, task.cut[:-1], task.cut[1:], strict=True):
            pair, times = task.pair[a:b], task.times[a:b].astype(float)
            docs, at = np.unique(task.doc[a:b], return_inverse=True)
            model = np.bincount(at, times * logp[pair], len(docs))
            few = rare[pair]
            some, at = np.unique(task.doc[a:b][few], return_inverse=True)
            known, own = (np.bincount(at, times[few] * x[pair[few]], len(some)) for x in (c > 0, base))
            # Partial sums are never positive; they go as whole steps, half a step off at most for each task and document.
            model, own = (_small(np.rint(-x * 2.0**bits).astype(np.int64)) for x, bits in ((model, SCORE_BITS), (own, BASE_BITS)))
            small = (_steps(docs), model, _steps(some), _small(known.astype(np.int64)), own)
            out.append((chunk, 0, _zip(small)))
        return pd.DataFrame(out, columns=["chunk", "kind", "blob"])

    def by_document(part: pd.DataFrame) -> pd.DataFrame:
        ids, held, tokens, n_known, base_score = _unzip(part.loc[part["kind"] == 1, "blob"].iloc[0])
        n_known, base_score, total_score = n_known.astype(np.int64), base_score.copy(), np.zeros(len(ids))
        for blob in part.loc[part["kind"] == 0, "blob"]:
            docs, model, some, known, own = _unzip(blob)
            total_score[_sums(docs)] -= model * 2.0**-SCORE_BITS
            n_known[_sums(some)] += known
            base_score[_sums(some)] -= own * 2.0**-BASE_BITS
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": tokens, "n_known": n_known,
                             "base_score": base_score, "score": total_score})

    scored = _answers(asked, tasks).groupBy("part").applyInPandas(finish, "chunk long, kind int, blob binary")
    rows = states.filter("kind = 1").select(F.col("part").alias("chunk"), "kind", "blob")  # there, part is the chunk
    return scored.union(rows).groupBy("chunk").applyInPandas(
        by_document, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
