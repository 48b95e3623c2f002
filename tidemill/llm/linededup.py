"""Repeated lines: line hashes and their window minima find matches, matches grow both ways, later copies go.

Lines are hashed by their words (as in ``vectext``: case of A-Z and white space play no part), at two scales.

*Lines as written.*  A text's lines end at newlines; lines without words don't count.  The shortest run of whole lines with at least
``LINE_WORDS`` words that begins at a line, or ends at one, is a window.  A line of so many words is a window by itself; shorter ones
make windows with their neighbours.  Every run of whole lines with ``LINE_WORDS`` words that two places share is covered by windows that both
have, so equal hashes of windows are all that has to be found: exactly the lines go that lie in a later occurrence of such a run.

*Lines wrapped at every word.*  A passage may begin inside a line, and its copies may be wrapped differently.  So each ``GRAM``
consecutive words are a line too.  Of every ``WINDOW`` consecutive ones the smallest hashes are fingerprints (winnowing); any run of
``GRAM + WINDOW - 1 = MIN_WORDS`` words that two places share, wherever it begins in either, holds the same fingerprints in both.
Each fingerprint's earliest occurrence is joined to every later one: as many matches as occurrences, however common the line.  A match is
extended word by word in both directions; a run of at least ``min_words`` words is deleted from the later place.
Matches whose run ends inside an already deleted one are only looked at for windows before it.

Where the earliest place does not share all of the ``min_words`` words long windows around a fingerprint (it is an edited copy, say),
those windows meet each other by their own hashes, again each its earliest place: first by hashes of the 32 bits a word
that are at hand, then, for the texts with a window that occurs twice so, by 64-bit hashes made from the texts.  The earliest place of
a fingerprint needs no part in this: who shares a window with it has met it.  So exactly the words go that lie in a later
occurrence of any ``min_words`` consecutive words.

Places come in the order of document ids, then positions.  Lines and windows are compared by 64-bit hashes, words on which runs of the second scale
grow by 32 bits, so a run's end may take in a word too many once in four thousand million runs.

Every deleted word has an earlier copy.  Deleted whole lines take their newline with them; a text of which no
word is left becomes empty.  Null texts stay null; empty texts and empty tables are allowed, very long texts are read whole.  Rows are told
apart by id and text: rows that repeat an id with another text are documents of their own (in the order of a hash of their texts),
rows equal in both are one document and are cut alike.  Rows without an id come last.  The columns ``runs`` and
``removed_words`` of the input are replaced, other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import vectext as V
from .store import LAST, Scratch, row_key
from .urlfilter import flagged

LINE_WORDS = 5
GRAM, MIN_WORDS = 20, 50
WINDOW = MIN_WORDS - GRAM + 1
_RUN = "array<struct<first: int, last: int, words: int, source: long>>"
#: Blocks of the broadcast filter that keeps rows without matches out of shuffles: 18 MB; a longer list shuffles all rows.
FILTER_BLOCKS = 1 << 18
KEY = ["rid", "mark"]
_ARROW_RUN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("words", pa.int32()), ("source", pa.int64())]))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values, by doubling: memory in proportion to x."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def winnow(key: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints: each window's minima."""
    n = len(key) - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h += key[k : k + n] * V.MULT[200 + k]
    h = V.mix(h)
    least = _slide(h, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), window, np.maximum) == h)
    return at, h[at]


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(kind)))


def line_windows(key: np.ndarray, line: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last words of the windows of whole lines, and their hashes; words have a hash, a line's number and a row's."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    begin = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])))
    end, own = np.append(begin[1:], n), row[begin]
    k = np.arange(len(begin))
    on = np.searchsorted(end, begin + least)  # windows that begin at each line
    back = np.searchsorted(begin, end - least, "right") - 1  # windows that end at each
    ahead, behind = np.minimum(on, len(k) - 1), np.maximum(back, 0)
    ok, ok_back = (on < len(k)) & (own[ahead] == own), (back >= 0) & (own[behind] == own)
    both = np.unique(np.concatenate([k[ok] * len(k) + on[ok], back[ok_back] * len(k) + k[ok_back]]))
    first, last = begin[both // len(k)], end[both % len(k)] - 1
    up, down = V._powers_to(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(key * up[:n], out=total[1:])
    return first, last, V.mix((total[last + 1] - total[first]) * down[first] + V.ADD[310])


def _rows(batches, gram, window, least):
    """Each text's words, its fingerprints (``lasts`` -1) and its windows of lines with their last words."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            data, offsets = V.utf8(batch.column("text"))
            words, marks, lasts, prints = [], [], [], []
            for i, j in V.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                key, start, _, row = V.words(part, offsets[i : j + 1] - offsets[i])
                short = (key >> np.uint64(32)).astype("<u4")
                at = V.row_bounds(row, 0, j - i)
                first, last, found = line_windows(key, np.cumsum(part == 10, dtype=np.int32)[start] if len(start) else start, row, least)
                where = np.searchsorted(first, at)
                for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    words.append(short[a:b].tobytes())
                    at_mark, grams = winnow(key[a:b], gram, window)
                    lines = slice(where[r], where[r + 1])
                    marks.append(np.concatenate([at_mark, first[lines] - a]))
                    lasts.append(np.concatenate([np.full(len(at_mark), -1), last[lines] - a]))
                    prints.append(np.concatenate([grams, found[lines]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEY), pa.array(words, pa.binary()), _lists(marks, np.int32), _lists(lasts, np.int32), _lists(prints, np.int64)],
                [*KEY, "words", "marks", "lasts", "prints"],
            )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, looked at in growing steps: the cost follows the result."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        to = min(at + step, n)
        other = a[at:to] != b[at:to]
        if other.any():
            return at + int(other.argmax())
        at, step = to, step * 4
    return n


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """First and last index in a of the equal run around a[i] == b[j]."""
    return i - _common(a[:i][::-1], b[:j][::-1]), i + _common(a[i:], b[j:]) - 1


def windows(key: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the ``width`` words from each start."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(width):
        h = h * V.MULT[300] + key[starts + k]
    return V.mix(h).view(np.int64)


def _matched(a: np.ndarray, b: np.ndarray, places: list[tuple[int, int]], min_words: int, window: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """First and last words of the runs of a that are in b too, and the starts of the windows around a's places that are in none of them."""
    runs, since, done, shift = [], 0, -1, None
    open_ = np.zeros(max(len(a) - min_words + 1, 0), bool)
    for i, j in places:
        open_[max(i - window + 1, 0) : i + 1] = True
        if i <= done and i - j == shift:
            continue
        beyond = done + 1
        if i <= done and (beyond >= len(a) or beyond - i + j >= len(b) or a[beyond] != b[beyond - i + j]):
            back = min(i, j, window - 1)  # no further than windows with this place reach
            if i - back >= since:  # all of it lies in a run that is known
                continue
            first, last = (x + i - back for x in extend(a[i - back : i + min_words], b[j - back : j + min_words], back, back))
        else:
            first, last = extend(a, b, i, j)
        if last - first + 1 >= min_words and (last > done or first < since):
            runs.append((first, last))
            since = min(since, first) if first <= done + 1 else first
            if last > done:
                done, shift = last, i - j
    for first, last in runs:
        open_[first : last - min_words + 2] = False
    return runs, np.flatnonzero(open_)


def _extended(batches, min_words, window):
    for batch in batches:
        found, starts, texts, before = [], [], [], 0
        places = batch.column("grams")
        bounds, flat = places.offsets.to_numpy(), places.values
        pos, at = (flat.field(c).to_numpy() for c in ("pos", "at"))
        for k in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u4") for c in ("words", "source_words"))
            mine = slice(bounds[k], bounds[k + 1])
            order = np.lexsort((at[mine], pos[mine]))
            source = batch.column("srid")[k].as_py()
            runs, rest = _matched(a, b, list(zip(pos[mine][order].tolist(), at[mine][order].tolist(), strict=True)), min_words, window)
            found.append([{"first": f, "last": t, "words": t - f + 1, "source": source} for f, t in runs])
            starts.append(rest)
            if len(rest):
                texts.append((before, a, rest))
                before += len(a)
        key = np.concatenate([a for _, a, _ in texts]).astype(np.uint64) if texts else np.zeros(0, np.uint64)
        hashes = windows(key, np.concatenate([rest + n for n, _, rest in texts]) if texts else np.zeros(0, np.int64), min_words)
        at = _lists(starts, np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(found, _ARROW_RUN), at, pa.ListArray.from_arrays(at.offsets, pa.array(hashes))], [*KEY, "runs", "starts", "hashes"])


def _hashed(batches, min_words):
    """The 64-bit hashes of the windows that begin at ``starts``."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            batch = whole.slice(k, 1000)
            data, offsets = V.utf8(batch.column("text"))
            starts, hashes = batch.column("starts"), []
            for i, j in V.slices(offsets):
                key, _, _, row = V.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = V.row_bounds(row, 0, j - i)
                own = [starts[n].values.to_numpy() + at[n - i] for n in range(i, j)]
                hashes.append(windows(key, np.concatenate(own), min_words))
            lists = pa.ListArray.from_arrays(_lists([x.values.to_numpy() for x in starts], np.int32).offsets, pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), starts, lists], [*KEY, "starts", "hashes"])


def _joined(batches, min_words):
    """Runs of windows that follow each other both here and in their earlier document."""
    for batch in batches:
        found = []
        for places in batch.column("places").to_pylist():
            runs, before = [], None
            for p in sorted(places, key=lambda p: p["pos"]):
                now = (p["source"], p["pos"] - p["at"], p["pos"])
                if before and now == (*before[:2], before[2] + 1):
                    runs[-1]["last"] += 1
                    runs[-1]["words"] += 1
                else:
                    runs.append({"first": p["pos"], "last": p["pos"] + min_words - 1, "words": min_words, "source": p["source"]})
                before = now
            found.append(runs)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(found, _ARROW_RUN)], [*KEY, "runs"])


def cut_slice(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Texts without the words first..last of each run (of the text ``row``), and how many words each lost."""
    n = len(offsets) - 1
    _, start, end, own = V.words(data, offsets)
    at = V.row_bounds(own, 0, n)
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, at[row] + np.minimum(first, np.diff(at)[row]), 1)
    np.add.at(edge, at[row] + np.minimum(last + 1, np.diff(at)[row]), -1)
    gone = np.cumsum(edge[:-1]) > 0
    lost = np.bincount(own[gone], minlength=n)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, start)
    other = np.append(True, own[1:] != own[:-1])[: len(own)]
    opens = other | np.append(True, line[1:] != line[:-1])[: len(own)]
    closes = np.append(opens[1:], True)[: len(own)]
    f = np.flatnonzero(gone & (other | ~np.append(False, gone[:-1])[: len(gone)]))
    t = np.flatnonzero(gone & (np.append(other[1:], True)[: len(gone)] | ~np.append(gone[1:], False)[: len(gone)]))
    begin, stop = offsets[own[f]], offsets[own[f] + 1]
    marks = np.concatenate([[-1], breaks, [len(data)]])
    a = np.where(opens[f], np.maximum(marks[np.searchsorted(breaks, start[f])] + 1, begin), start[f])
    b = np.minimum(marks[np.searchsorted(breaks, end[t]) + 1] + 1, stop)
    tail = closes[t] & ~opens[f]  # a line's beginning stays, and so does its newline
    a[tail] = end[f[tail] - 1]
    b[tail] -= data[b[tail] - 1] == 10
    on = ~closes[t]
    b[on] = start[t[on] + 1]
    away = np.zeros(len(data) + 1, np.int64)
    np.add.at(away, a, 1)
    np.add.at(away, b, -1)
    stay = np.cumsum(away[:-1]) == 0
    kept, where = data[stay].tobytes(), np.concatenate([[0], np.cumsum(stay)])[offsets]
    out = []
    for k in range(n):
        text = kept[where[k] : where[k + 1]]
        if at[k + 1] > at[k] and gone[at[k + 1] - 1]:
            if lost[k] == at[k + 1] - at[k]:
                text = b""
            elif data[offsets[k + 1] - 1] != 10:
                text = text.rstrip(b"\n")
        out.append(text)
    return out, lost


def cut(text: bytes, runs: list[dict]) -> tuple[bytes, int]:
    """The text without the words of the runs, and how many those are."""
    first, last = (np.array([r[c] for r in runs], np.int64) for c in ("first", "last"))
    out, lost = cut_slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.zeros(len(runs), np.int64), first, last)
    return out[0], int(lost[0])


def _cut_rows(batches, text_at):
    for batch in batches:
        runs, column = batch.column("__runs"), batch.column(text_at)
        lost = np.zeros(batch.num_rows, np.int64)
        having = pc.and_(runs.is_valid(), column.is_valid())
        some = np.flatnonzero(having.to_numpy(zero_copy_only=False))
        if len(some):
            data, offsets = V.utf8(column.take(pa.array(some)))
            held = runs.take(pa.array(some))
            bounds, flat = held.offsets.to_numpy(), held.values
            first, last = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            texts = []
            for i, j in V.slices(offsets):
                mine = slice(bounds[i], bounds[j])
                row = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
                new, lost[some[i:j]] = cut_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], row, first[mine], last[mine])
                texts += new
            column = pc.replace_with_mask(column, having, pa.array(texts, pa.binary()).cast(column.type))
        cols = [column if k == text_at else batch.column(k) for k in range(batch.num_columns - 1)]
        names = batch.schema.names[:-1]
        yield pa.RecordBatch.from_arrays([*cols, runs, pa.array(lost)], [*names, "runs", "removed_words"])


def _possible(rows: DataFrame, some: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``__maybe``: false only for those whose key is not among ``some``."""
    keys = scratch.put(some.select(F.xxhash64(*KEY).alias("key")).distinct(), name)
    return flagged(rows, F.xxhash64(*[F.col(f"`{c}`") for c in KEY]), keys, keys.count(), FILTER_BLOCKS, deal=False)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rid, mark, runs``: what is to be deleted, for rows (by ``row_key``) that have any (word numbers, words, the earlier document)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    gram = min(GRAM, min_words)
    window = min_words - gram + 1
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    if not texts.groupBy("rid").count().filter("count > 1").isEmpty():
        texts = texts.dropDuplicates(KEY)
    else:
        texts = texts.withColumn("mark", F.lit(0).cast("long"))  # ids say which row is meant
    kinds = "rid long, mark long, words binary, marks array<int>, lasts array<int>, prints array<long>"
    rows = scratch.put(texts.mapInArrow(lambda it: _rows(it, gram, window, line_words), kinds), "rows")

    # Both scales in one pass: each hash's earliest place, and every later one joined to it.
    places = rows.select(*KEY, F.explode(F.arrays_zip("marks", "lasts", "prints")).alias("m")).select(F.col("m.prints").alias("key"), *KEY, F.col("m.marks").alias("pos"), F.col("m.lasts").alias("last"))
    earliest = places.groupBy("key").agg(F.min(F.struct(*KEY, "pos")).alias("e"), F.count("*").alias("n")).filter("n > 1").drop("n")
    earliest = scratch.put(earliest, "earliest")  # a join of two shuffles, whose hot partitions Spark can split
    matches = (
        places.join(earliest, "key")
        .filter("rid <> e.rid or mark <> e.mark or pos <> e.pos")
        .groupBy(*KEY, F.col("e.rid").alias("srid"), F.col("e.mark").alias("smark"))
        .agg(F.collect_list(F.when(F.col("last") < 0, F.struct("pos", F.col("e.pos").alias("at")))).alias("grams"), F.collect_list(F.when(F.col("last") >= 0, F.struct("pos", "last"))).alias("lines"))
    )
    matches = scratch.put(matches, "matches")
    pairs = matches.filter("size(grams) > 0").select(*KEY, "srid", "smark", "grams")
    involved = pairs.select(*KEY).union(pairs.select("srid", "smark"))
    words = _possible(rows.select(*KEY, "words"), involved, scratch, "involved").filter("__maybe").drop("__maybe")
    full = (
        pairs.join(words, KEY)
        .join(words.select(F.col("rid").alias("srid"), F.col("mark").alias("smark"), F.col("words").alias("source_words")), ["srid", "smark"])
        .select(*KEY, "srid", "grams", "words", "source_words")
    )
    kinds = f"rid long, mark long, runs {_RUN}, starts array<int>, hashes array<long>"
    found = scratch.put(full.mapInArrow(lambda it: _extended((b.slice(i, 200) for b in it for i in range(0, b.num_rows, 200)), min_words, window), kinds), "found")

    def occurrences(df):
        return df.select(*KEY, F.explode(F.arrays_zip("hashes", "starts")).alias("m")).select(F.col("m.hashes").alias("key"), *KEY, F.col("m.starts").alias("pos"))

    def earliest_of(df, name):
        here = F.struct(*KEY, "pos")
        return scratch.put(df.groupBy("key").agg(F.min(here).alias("e"), F.max(here).alias("l")).filter("e <> l").drop("l"), name)

    open_ = occurrences(found)
    again = open_.join(earliest_of(open_, "alike").select("key"), "key").groupBy(*KEY).agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    again = scratch.put(again, "again")
    scratch.drop("rows", "earliest", "alike", "involved")
    few = _possible(texts, again, scratch, "wanted").filter("__maybe").drop("__maybe")
    exact = scratch.put(few.join(again, KEY).mapInArrow(lambda it: _hashed(it, min_words), "rid long, mark long, starts array<int>, hashes array<long>"), "exact")
    same = occurrences(exact)
    later = (
        same.join(earliest_of(same, "same"), "key")
        .filter("rid <> e.rid or mark <> e.mark or pos <> e.pos")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("pos", F.col("e.rid").alias("source"), F.col("e.pos").alias("at"))).alias("places"))
    )
    more = later.mapInArrow(lambda it: _joined(it, min_words), f"rid long, mark long, runs {_RUN}")
    lines = matches.filter("size(lines) > 0").select(*KEY, F.expr("transform(lines, x -> struct(x.pos as first, x.last as last, x.last - x.pos + 1 as words, srid as source))").alias("runs"))
    runs = found.filter("size(runs) > 0").select(*KEY, "runs").unionByName(more).unionByName(lines)
    source = f"transform(flatten(collect_list(runs)), x -> struct(x.first as first, x.last as last, x.words as words, nullif(x.source, {LAST}L) as source))"
    out = scratch.put(runs.groupBy(*KEY).agg(F.expr(source).alias("runs")), "runs")
    scratch.drop("matches", "found", "again", "exact", "same", "wanted")
    return out


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shortened texts, and the columns ``runs`` (null: none) and ``removed_words`` (in place of columns of that name)."""
    runs = repeated_runs(docs, min_words, line_words, id_col, text_col).withColumnRenamed("runs", "__runs")
    scratch = Scratch(docs.sparkSession, "cuts")
    names = [c for c in docs.columns if c not in ("runs", "removed_words")]
    text_at = names.index(text_col)
    own = [F.col(f"`{c}`") for c in names]
    rid, mark = row_key(id_col, text_col)
    plain = runs.filter("mark <> 0").isEmpty()  # as repeated_runs chose
    keyed = docs.select(*own, rid.alias("__rid"), (F.lit(0).cast("long") if plain else mark).alias("__mark"))
    cuts = runs.select(F.col("rid").alias("__rid"), F.col("mark").alias("__mark"), "__runs")
    keys = scratch.put(cuts.select(F.xxhash64("__rid", "__mark").alias("key")), "keys")
    asked = flagged(keyed, F.xxhash64("__rid", "__mark"), keys, keys.count(), FILTER_BLOCKS, deal=False)
    # Rows that the filter does not pass have no runs and need no shuffle.
    clear = asked.filter("not __maybe").select(*own, F.lit(None).cast(_RUN).alias("runs"), F.lit(0).cast("long").alias("removed_words"))
    cuts = cuts.hint("merge")  # how many runs there are depends on the data: one plan at every size
    joined = asked.filter("__maybe").join(cuts, ["__rid", "__mark"], "left").select(*own, "__runs")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return clear.unionByName(joined.mapInArrow(lambda it: _cut_rows((b.slice(i, 500) for b in it for i in range(0, b.num_rows, 500)), text_at), f"{kinds}, runs {_RUN}, removed_words long"))
