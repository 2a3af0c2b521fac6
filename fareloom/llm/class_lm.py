"""Class-based bigram language model in the manner of Brown, learned and applied at corpus scale.

Counts of all training words stay a Spark table.  The ``FREQUENT`` commonest words are broadcast (a
stated number), so that most tokens are looked up inside their task; tokens of the other words are
joined with the table, per row and distinct word, and no common word takes part in that join.  Texts are
read twice: for the counts, and to be written as numbers of their words.

Every training word is put into a class by its own neighbours.  There are as many classes as the cube root
of the number of distinct words (``CLASSES`` at least), so the model grows with the corpus.

1. Exchange clustering, one move after the other, deals the commonest words (``UNITS``, or twice the classes)
   and ``RARE_UNITS`` groups of all others by their ending into the classes, as long as the likelihood of the
   class bigram grows.  A group's class is a start for its words only.
2. In ``SWEEPS`` rounds all other broadcast words move at once, each to the class that its neighbours' classes
   fit best (``Fit``).  These are counted per task and summed per block of words.
3. The words that are not broadcast move in the same way, in tasks that hold one word's occurrences together.

Only a word that no training text has takes its class from its ending: the class that most joined words of
that ending are in.  A text's score is the sum over its tokens, the end included, of log10 P(class | class
before) + log10 P(word | class), both with one added, and one unseen word in every class (a text starts
after an end).

Defined results: null and empty texts consist of their end; a null key is held out; without training
rows all counts are zero; repeated rows are scored one by one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

FREQUENT = 150_000
UNITS, RARE_UNITS, CLASSES = 448, 64, 40
ROUNDS, SWEEPS = 15, 2
HELD = 200_000  #: distinct words a counting task holds before it hands them on
HELD_PAIRS = 4_000_000  #: neighbours a task holds before it sums them
HELD_ROWS = 50_000  #: sorted rows that are worked on together, about
CELLS = 2_000_000  #: likelihoods that are worked out together
JOINED = 65535  #: stands for the class of a word that is not broadcast, until it is joined
END = "\n"  #: no word contains white space


def tokens(text: str | None) -> list[bytes]:
    """Bytes are lower-cased in ASCII only and split at ASCII white space only."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b"\n"]


def held_out(key: str, folds: int = 7, fold: int = 2):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(True))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) over ``text`` of all rows; the end is a word."""

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()),
                                               pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(tokens(text))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return (train.select("text").mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("c")))


def common_words(counts: DataFrame, most: int) -> list:
    """Rows of the commonest words, ``most`` of them at most: words from the smallest count class (a
    64th of a power of two) on at which they are no more.  The classes are few, so is what is sent."""
    bin_of = F.floor(F.log2("c") * 64).cast("int")
    bins = sorted(counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("v")).collect(), reverse=True)
    least, total = None, 0
    for row in bins:
        total += row.v
        if total > most:
            break
        least = row.bin
    if least is None:
        return []
    return sorted(counts.where(bin_of >= least).collect(), key=lambda r: (-r.c, r.word))


def class_number(words: int) -> int:
    """Classes for a vocabulary of ``words``."""
    return max(CLASSES, int(np.ceil(words ** (1 / 3))))


def rare_unit(ending: str) -> int:
    return zlib.crc32(ending.encode("utf-8", "surrogatepass")) % RARE_UNITS


class Lookup:
    """Words to numbers, commonest first; other words have an ending."""

    def __init__(self, words: list[str]):
        self.number = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
        self.endings: dict = {}

    def ending(self, word: bytes) -> int:
        """Unit of the ending (two characters)."""
        ending = word[-8:].decode("utf-8", "ignore")[-2:]
        unit = self.endings.get(ending)
        if unit is None:
            unit = rare_unit(ending)
            if len(self.endings) < 100_000:
                self.endings[ending] = unit
        return unit

    def coded(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of common words; -1 - k for the k-th of the other words, which are the second part."""
        get, rare = self.number.get, {}
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            ids = [i if i >= 0 else ~rare.setdefault(w, len(rare)) for i, w in zip(ids, words)]
        return np.array(ids, np.int32), list(rare)


def coded_rows(plain: DataFrame, shared, kind: str) -> DataFrame:
    """Texts as numbers: ``ids`` (see ``Lookup.coded``), the words that are not broadcast, and their endings."""

    def code(batches):
        look, at = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, ends, words, sizes = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                numbers, rare = look.coded(tokens(text))
                ids.append(numbers.tobytes())
                ends.append(bytes(map(look.ending, rare)))
                words += rare
                sizes.append(len(words))
            rows = at + np.arange(batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("id"), batch.column("held_out"), pa.array(ids, pa.binary()),
                 pa.array(ends, pa.binary()), pa.ListArray.from_arrays(
                     pa.array(sizes, pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))],
                ["row", "id", "held_out", "ids", "ends", "rare"])

    return plain.mapInArrow(code, f"row long, id {kind}, held_out boolean, ids binary, ends binary, rare array<string>")


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    data = column.to_pylist()
    return (np.frombuffer(b"".join(data), kind),
            np.array([len(d) for d in data], np.int64) // np.dtype(kind).itemsize)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows one after the other (-1 - k: the k-th joined word of the batch), their number per row,
    and the endings of the joined words."""
    ids, sizes = _values(batch.column("ids"), np.int32)
    ends, some = _values(batch.column("ends"), np.uint8)
    first = np.cumsum(some) - some
    return np.where(ids < 0, ids - np.repeat(first, sizes), ids), sizes, ends


def _of_tokens(ids: np.ndarray, common: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Each token's value among those of the common words, or of the batch's joined words."""
    out = common[np.maximum(ids, 0)] if len(common) else np.zeros(len(ids), rare.dtype)
    at = np.flatnonzero(ids < 0)
    out[at] = rare[~ids[at]]
    return out


def _pairs(rows: DataFrame, n: int, numbers) -> np.ndarray:
    """How often each of ``n`` numbers follows each: a matrix of stated size.  ``numbers(batch)`` gives those of all
    tokens.  Every text ends with an end, which the next one starts after, so a batch is a circle."""

    def count(batches):
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            u = numbers(batch).astype(np.int64)
            total += np.bincount(np.roll(u, 1) * n + u, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(n * n)
    pairs[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return pairs.reshape(n, n)


def pairs_by(train: DataFrame, n: int, common: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """The same where a word's number stands in ``common``, or in ``endings`` at its ending."""
    shared = train.sparkSession.sparkContext.broadcast((common, endings))

    def numbers(batch):
        ids, _, ends = _flat(batch)
        return _of_tokens(ids, shared.value[0], shared.value[1][ends])

    return _pairs(train.select("ids", "ends"), n, numbers)


def _xlogx(a):
    return a * np.log(np.maximum(a, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: units move one by one to the class that raises the likelihood most."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    cls = np.zeros(n, np.int64)
    cls[order] = np.arange(n) % classes
    onehot = np.eye(classes)[cls]
    big = onehot.T @ pairs @ onehot
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            a, own = cls[u], pairs[u, u]
            onehot[u] = 0
            out, into = pairs[u] @ onehot, pairs[:, u] @ onehot  # to and from each class, without u
            big[a] -= out
            big[:, a] -= into
            big[a, a] -= own
            left, right = big.sum(1) + into, big.sum(0) + out  # these stay wherever u goes
            row = _xlogx(big + out[None, :]) - _xlogx(big)  # u's words join class b (row b)
            column = _xlogx(big + into[:, None]) - _xlogx(big)
            diag = np.diagonal(big)
            gain = (row.sum(1) - np.diagonal(row) + column.sum(0) - np.diagonal(column)
                    + _xlogx(diag + out + into + own) - _xlogx(diag)
                    - (_xlogx(left + out.sum() + own) - _xlogx(left))
                    - (_xlogx(right + into.sum() + own) - _xlogx(right)))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            cls[u] = b
            onehot[u, b] = 1
            big[b] += out
            big[:, b] += into
            big[b, b] += own
        if not moved:
            break
    return cls


class Fit:
    """How well a word's neighbours fit each class: the log-likelihood of their classes after and before a word of it.

    One is added to every count, and a word's own class is looked at without that word.  So all words may move at once:
    a class draws no word by the counts that the word itself would bring, be the class small or empty.
    """

    def __init__(self, big: np.ndarray):
        n = len(big)
        self.cells = np.concatenate([big, big.T])  # row c: pairs after class c; row n + c: pairs before it
        self.sums = np.repeat([big.sum(0), big.sum(1)], n, axis=0)
        self.logs = np.log((self.cells + 1) / (self.sums + n))

    def best(self, word: np.ndarray, at: np.ndarray, times: np.ndarray, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The class of each word.  An entry says that ``word`` (a place in ``own`` and ``count``, in order) meets
        row ``at`` of the cells ``times`` times; every word has entries.  ``own`` are the classes now."""
        n, found = self.cells.shape[1], own.copy()
        starts = np.searchsorted(word, np.arange(len(own) + 1))
        lo = 0
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CELLS // n, "right")) - 1)
            part = slice(starts[lo], starts[hi])
            w, row, m, cls = word[part], at[part], times[part], own[lo:hi]
            mine = own[w]
            fit = self.logs[row]
            fit[np.arange(len(w)), mine] = np.log((self.cells[row, mine] - m + 1) / (self.sums[row, mine] - count[w] + n))
            fit *= m[:, None]
            fit = np.add.reduceat(fit, starts[lo:hi] - starts[lo], axis=0)
            each, b = np.arange(hi - lo), np.argmax(fit, axis=1)
            found[lo:hi] = np.where(fit[each, b] > fit[each, cls] + 1e-9, b, cls)
            lo = hi
        return found


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sweep(train: DataFrame, common: np.ndarray, endings: np.ndarray, big: np.ndarray, first: int,
          times: np.ndarray) -> np.ndarray:
    """New classes of the common words, those before ``first`` as they are."""
    n, context = len(big), train.sparkSession.sparkContext
    width, per = 2 * n, max(1, 65536 // (2 * n))  # a block's places fit 16 bits
    kind = np.uint16 if width <= 65536 else np.int64
    shared, fit, amount = context.broadcast((common, endings)), context.broadcast(Fit(big)), context.broadcast(times)

    def count(batches):
        held, size = [], 0

        def out():
            keys, n_of = np.unique(np.concatenate(held), return_counts=True)
            block = keys // (per * width)
            ends = np.flatnonzero(np.diff(block, append=-1)) + 1
            starts = np.r_[0, ends[:-1]]
            steps, n_of = np.diff(keys, prepend=0), n_of.astype(np.int32)  # places as steps, which are small numbers
            steps[starts] = keys[starts] - block[starts] * (per * width)
            steps = steps.astype(kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(block[starts]), pa.array(ends - starts)]
                + [pa.array([pa.compress(v[i:j].tobytes(), "zstd", asbytes=True) for i, j in zip(starts, ends)], pa.binary())
                   for v in (steps, n_of)], ["block", "size", "steps", "n"])

        for batch in batches:
            ids, _, ends = _flat(batch)
            cls = _of_tokens(ids, shared.value[0], shared.value[1][ends]).astype(np.int64)
            some = np.flatnonzero(ids >= first)
            word = ids[some].astype(np.int64) * width
            held += [word + np.roll(cls, 1)[some], word + n + np.roll(cls, -1)[some]]
            size += 2 * len(some)
            if size > HELD_PAIRS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def move(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        total = np.zeros(per * width, np.int64)
        for size, *parts in zip(*(table.column(c).to_pylist() for c in ("size", "steps", "n"))):
            steps, n_of = (np.frombuffer(pa.decompress(p, size * np.dtype(t).itemsize, "zstd"), t)
                           for p, t in zip(parts, (kind, np.int32)))
            total[np.cumsum(steps, dtype=np.int64)] += n_of
        at = np.flatnonzero(total)
        words, word = np.unique(at // width, return_inverse=True)
        numbers = words + block * per
        new = fit.value.best(word, at % width, total[at], shared.value[0][numbers], amount.value[numbers])
        return pa.table({"numbers": pa.array([numbers.astype(np.int64).tobytes()], pa.binary()),
                         "classes": pa.array([new.astype(np.int64).tobytes()], pa.binary())})

    moved = (train.select("ids", "ends").mapInArrow(count, "block long, size long, steps binary, n binary")
             .repartition(_tasks(train), "block").groupBy("block").applyInArrow(move, "numbers binary, classes binary"))
    out = common.copy()
    for row in moved.collect():
        out[np.frombuffer(row.numbers, np.int64)] = np.frombuffer(row.classes, np.int64)
    return out


def _whole_groups(batches, key: str):
    """Tables of sorted rows with the places where a group starts; no group is cut."""
    held, size = [], 0

    def cut(last: bool):
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).chunk(0)
        new = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(new) + 1]
        if last:
            return table, starts, None
        return table.slice(0, starts[-1]).combine_chunks(), starts[:-1], table.slice(starts[-1])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > HELD_ROWS:
            table, starts, rest = cut(False)
            if len(starts):
                yield table, starts
            held, size = rest.to_batches(), 0
    if held:
        yield cut(True)[:2]


def joined_classes(train: DataFrame, common: np.ndarray, endings: np.ndarray, big: np.ndarray) -> DataFrame:
    """(word, c, cls) of the training words that are not broadcast."""
    n, context = len(big), train.sparkSession.sparkContext
    shared, fit = context.broadcast((common, endings)), context.broadcast(Fit(big))

    def occurrences(batches):
        for batch in batches:
            ids, _, ends = _flat(batch)
            cls = _of_tokens(ids, shared.value[0], shared.value[1][ends]).astype(np.int64)
            at = np.flatnonzero(ids < 0)
            code = (cls[at] * n + np.roll(cls, 1)[at]) * n + np.roll(cls, -1)[at]
            yield pa.RecordBatch.from_arrays([batch.column("rare").flatten().take(pa.array(~ids[at])), pa.array(code)],
                                             ["word", "code"])

    def move(batches):
        for table, starts in _whole_groups(batches, "word"):
            code = table.column("code").to_numpy()
            count = np.diff(np.r_[starts, len(code)])
            word = np.repeat(np.arange(len(starts)), count) * (2 * n)
            keys, times = np.unique(np.concatenate([word + code // n % n, word + n + code % n]), return_counts=True)
            new = fit.value.best(keys // (2 * n), keys % (2 * n), times, code[starts] // (n * n), count)
            yield pa.RecordBatch.from_arrays([table.column("word").chunk(0).take(pa.array(starts)), pa.array(count),
                                              pa.array(new.astype(np.int32))], ["word", "c", "cls"])

    return (train.select("ids", "ends", "rare").mapInArrow(occurrences, "word string, code long")
            .repartition(_tasks(train), "word").sortWithinPartitions("word")
            .mapInArrow(move, "word string, c long, cls int"))


def classed_rows(coded: DataFrame, learned: DataFrame, model, kind: str) -> DataFrame:
    """Every row with the classes of its tokens, how many it has and knows, and the sum of their log10 (count + 1).

    ``model`` is the broadcast of the common words' classes, their log10, and the class of each unseen ending.
    """

    def by_row(batches):
        for table, starts in _whole_groups(batches, "row"):
            ends = np.r_[starts[1:], table.num_rows]
            held = {name: table.column(name).to_numpy().astype(np.int64) for name in ("k", "c", "cls")}
            yield pa.RecordBatch.from_arrays(
                [table.column("row").chunk(0).take(pa.array(starts))]
                + [pa.array([v[i:j].astype(t).tobytes() for i, j in zip(starts, ends)], pa.binary())
                   for v, t in zip(held.values(), (np.int32, np.int64, np.int32))], ["row", "k", "c", "cls"])

    def begin(batches):
        common, logs, _ = model.value
        for batch in batches:
            ids, sizes = _values(batch.column("ids"), np.int32)
            starts, rare, places = np.cumsum(sizes) - sizes, ids < 0, np.maximum(ids, 0)
            classes = np.where(rare, JOINED, common[places] if len(common) else JOINED).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("held_out"), batch.column("ends"), pa.array(sizes),
                 pa.array(np.add.reduceat((~rare).astype(np.int64), starts)),
                 pa.array(np.add.reduceat(np.where(rare, 0.0, logs[places] if len(logs) else 0.0), starts)),
                 pa.array([classes[i:i + s].tobytes() for i, s in zip(starts, sizes)], pa.binary()),
                 pa.array([(~part[part < 0]).tobytes() for i, s in zip(starts, sizes) for part in (ids[i:i + s],)], pa.binary())],
                ["row", "id", "held_out", "ends", "tokens", "known", "logs", "classes", "marks"])

    def finish(batches):
        unseen = model.value[2]
        for batch in batches:
            classes, sizes = _values(batch.column("classes"), np.uint16)
            ends, some = _values(batch.column("ends"), np.uint8)
            marks, n_marks = _values(batch.column("marks"), np.int32)
            first = np.cumsum(some) - some
            k, n_found = _values(pc.fill_null(batch.column("k"), b""), np.int32)
            at = k + np.repeat(first, n_found)
            count, cls = np.zeros(len(ends), np.int64), unseen[ends]
            count[at] = _values(pc.fill_null(batch.column("c"), b""), np.int64)[0]
            cls[at] = _values(pc.fill_null(batch.column("cls"), b""), np.int32)[0]
            marks = marks + np.repeat(first, n_marks)
            classes = classes.copy()
            classes[classes == JOINED] = cls[marks]
            row, count = np.repeat(np.arange(batch.num_rows), n_marks), count[marks]
            known = np.bincount(row, count > 0, batch.num_rows).astype(np.int64)
            logs = np.bincount(row, np.log10(count + 1), batch.num_rows)
            starts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), batch.column("tokens"),
                 pa.array(batch.column("known").to_numpy(zero_copy_only=False) + known),
                 pa.array(batch.column("logs").to_numpy(zero_copy_only=False) + logs),
                 pa.array([classes[i:i + s].tobytes() for i, s in zip(starts, sizes)], pa.binary())],
                ["id", "held_out", "tokens", "known", "logs", "classes"])

    asked = coded.select("row", F.posexplode("rare").alias("k", "word"))
    found = (asked.join(learned, "word").select("row", "k", "c", "cls")
             .repartition(_tasks(coded), "row").sortWithinPartitions("row")
             .mapInArrow(by_row, "row long, k binary, c binary, cls binary"))
    begun = coded.drop("rare").mapInArrow(begin, (
        f"row long, id {kind}, held_out boolean, ends binary, tokens long, known long, logs double, classes binary, marks binary"))
    return begun.join(found, "row", "left").drop("row").mapInArrow(
        finish, f"id {kind}, held_out boolean, tokens long, known long, logs double, classes binary")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text",
          frequent: int = FREQUENT) -> DataFrame:
    """Scores of all rows by a model of those that are not held out."""
    context = docs.sparkSession.sparkContext
    plain = docs.select(F.col(key).alias("id"), held_out(key).alias("held_out"),
                        F.coalesce(text, F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    counts = materialise(word_counts(plain.where("not held_out")), "lm-counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n_train, v_train = int(totals.n or 0), int(totals.v)
    top = common_words(counts, frequent)
    amounts = np.array([r.c for r in top], np.int64)
    coded = materialise(coded_rows(plain, context.broadcast(Lookup([r.word for r in top])), kind), "lm-coded", compression="zstd")
    train = coded.where("not held_out")

    # classes: the commonest words and the endings one by one, then all common words, then all others
    n = class_number(v_train)
    head = min(len(top), max(UNITS, 2 * n))
    of_top = np.array([rare_unit(r.word[-2:]) for r in top], np.int64)
    units = np.where(np.arange(len(top)) < head, np.arange(len(top)), head + of_top)
    pairs = pairs_by(train, head + RARE_UNITS, units, head + np.arange(RARE_UNITS))
    cls = exchange(pairs, n)
    common, endings = cls[units], cls[head:]
    for _ in range(SWEEPS if len(top) > head else 0):
        common = sweep(train, common, endings, pairs_by(train, n, common, endings), head, amounts)
    learned = materialise(joined_classes(train, common, endings, pairs_by(train, n, common, endings)), "lm-classes")

    types = np.bincount(common, minlength=n).astype(float)
    amount = np.bincount(common, amounts, n)
    by_ending = np.zeros((RARE_UNITS, n))
    for unit, b, v, c in learned.groupBy(F.crc32(F.expr("right(word, 2)")) % RARE_UNITS, "cls").agg(
            F.count("*"), F.sum("c")).collect():
        by_ending[unit, b] = v
        amount[b] += c
    types += by_ending.sum(0)
    unseen = np.where(by_ending.any(1), by_ending.argmax(1), endings)
    words = context.broadcast((common, np.log10(amounts + 1), unseen))
    rows = materialise(classed_rows(coded, learned, words, kind), "lm-rows")
    by_class = _pairs(rows.where("not held_out").select("classes"), n,
                      lambda batch: _values(batch.column("classes"), np.uint16)[0])
    step = np.log10((by_class + 1) / (by_class.sum(1, keepdims=True) + n)) - np.log10(amount + types + 1)[None, :]
    model = context.broadcast(step)

    def steps(batches):
        for batch in batches:
            cls, sizes = _values(batch.column("classes"), np.uint16)
            total = np.add.reduceat(model.value[np.roll(cls, 1), cls], np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], [*batch.schema.names[:-1], "steps"])

    lost = float(np.log10(n_train + v_train + 1))
    result = rows.mapInArrow(
        steps, f"id {kind}, held_out boolean, tokens long, known long, logs double, steps double").select(
        F.col("id").alias(key), "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("tokens") * lost).alias("base_score"),
        (F.col("logs") + F.col("steps")).alias("score"))
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
