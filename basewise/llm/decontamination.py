"""Benchmark decontamination by templates.

Texts are cut into words at ASCII white space, lower-cased and stripped of outer punctuation. In their templates numbers,
units after a number and names become typed placeholders whose text is the slot's filler. A name is a capitalised word;
as any word may stand capitalised where a sentence begins, a text has two templates, with such words as they are and as names, and its plain
words beside them, so that copies in other case match. Windows of ``window`` words of all three are hashed and joined with the windows of the
benchmark items. The hits of a document and an item are counted by region, twice the item's length at most, and the slot fillers under them
compared: a copy fills all slots alike, a re-parameterised question maps each filler of the item to one filler of the document and
each of these to one of the item. A document leaks an item if hits in one region cover at least ``min_similarity`` of the item's windows and its slots are consistent.

The join is a broadcast join while the item windows number at most ``BROADCAST_WINDOWS`` (checked), and
before it tasks drop windows whose hash is not in a bit map of fixed size built from the items; with
more item windows neither is used and the join shuffles.

Defined cases: null, empty and blank texts have no windows and no leaks. Items of 3 words up to ``window`` - 1 are found inside texts by windows of their own
length, as plain words; items of 1 or 2 words only in texts that are nothing else. Items without words are ignored. A window with fewer than two words
that are no placeholders is shared by too many texts to be evidence as a template and counts only in items that are nothing else. Each row of documents and each row of
items is judged by itself, whether its id is null or repeated or not: ``find_leaks`` has a row for each pair of rows. Empty tables give no leaks. Other columns, whatever their names, pass through ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, free, kept, named, released, staged

WINDOW = 5
MIN_SIMILARITY = 0.8
BROADCAST_WINDOWS = 2_000_000
MAP_BITS = 24
#: Ids of leaking documents up to which they are broadcast; a shuffle join beyond.
BROADCAST_LEAKS = 1_000_000
#: Shorter items are found only in texts that are nothing else.
LEAST_WORDS = 3
OUTER = ".,;:!?\"'()[]{}«»¿¡…|"
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*%?$")
#: Unit words, without their dots.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h m/s hz khz mhz ghz v w kw kwh j kj cal kcal "
    "c f k °c °f degree degrees percent % dollar dollars euro euros cent cents usd eur gbp".split()
)
#: Words that each of two generations of a task's memory holds, and bytes of the longest such word.
MEMO, LONGEST = 250_000, 64
NUM, UNIT, NAME = "\x01num", "\x01unit", "\x01name"
#: A mark for line ends, where sentences end.
LINE = b"\x00"

#: Marks alone and line ends are no words; a sentence may begin behind them.
PLAIN, IS_NUMBER, MAYBE_UNIT, CAPITAL, NO_WORD = range(5)


def _word(raw: bytes) -> tuple[int, int, bool, str]:
    """Kind, hash of the lower-case form, whether a sentence ends here, and the bare word."""
    if raw.isalpha() and raw.islower():  # ASCII letters, the most frequent case
        text = raw.decode()
        return MAYBE_UNIT if text in UNITS else PLAIN, xxhash.xxh64_intdigest(raw), False, text
    text = raw.decode("utf-8", "replace")
    bare = text.strip(OUTER)
    low = bare.lower()
    kind = PLAIN
    if not bare or raw == LINE:
        kind = NO_WORD
    elif not bare[0].isalpha() and NUMBER.match(bare):
        kind = IS_NUMBER
    elif low in UNITS:
        kind = MAYBE_UNIT
    elif low != bare and bare[:1].isupper() and bare[1:].islower():
        kind = CAPITAL
    stops = not text[-1:].isalnum() and (text.rstrip("\"')]»")[-1:] in ".!?:…" or raw == LINE)
    return kind, xxhash.xxh64_intdigest(low), stops, bare


_FIXED: dict[str, int] = {}

#: Hashes of a text's words, and the filler of each slot by position.
Template = tuple[np.ndarray, dict[int, str]]


def templates(text: str | None) -> tuple[np.ndarray, Template, Template]:
    """The plain words' hashes, the template in which words that begin a sentence are no names, and that in which they are."""
    if not _FIXED:
        _FIXED.update({x: xxhash.xxh64_intdigest(x) for x in (NUM, UNIT, NAME)})
    hashes, changed, names, begins, number = [], {}, {}, True, False
    memo = kept("templates", lambda: [{}, {}])
    of, append = memo[0].get, hashes.append
    words = (text or "").encode().replace(b"\n", b" \x00 ").split()
    for raw, w in zip(words, map(of, words)):  # looked up one by one, so what is learned on the way is known
        if w is None:
            w = memo[0].get(raw) or memo[1].get(raw) or _word(raw)
            if len(raw) <= LONGEST:
                if len(memo[0]) >= MEMO:
                    memo[:] = {}, memo[0]
                memo[0][raw] = w
        kind, h, stops, bare = w
        if kind:
            if kind == NO_WORD:
                begins = begins or stops
                continue
            if kind == IS_NUMBER:
                changed[len(hashes)] = NUM, bare
            elif kind == MAYBE_UNIT and number:
                changed[len(hashes)] = UNIT, bare.lower()
            elif kind == CAPITAL:
                (names if begins else changed)[len(hashes)] = NAME, bare
            number = kind == IS_NUMBER
        else:
            number = False
        append(h)
        begins = stops
    plain = np.array(hashes, np.uint64)

    def filled(slots: dict[int, tuple[str, str]]) -> Template:
        out = plain.copy()
        out[list(slots)] = np.array([_FIXED[t] for t, _ in slots.values()], np.uint64)
        return out, {i: x for i, (_, x) in sorted(slots.items())}

    return plain, filled(changed) if changed else (plain, {}), filled(changed | names) if names else (plain, {})


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    out = np.full(max(0, len(h) - n + 1) if n else 0, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _mostly_slots(slots: dict[int, str], n: int, window: int) -> np.ndarray:
    """Which windows hold fewer than two words that are no placeholders."""
    full = np.zeros(n + 1, np.int64)
    full[np.array(list(slots), np.int64) + 1] = 1
    full = np.cumsum(full)
    return full[window:] - full[: n + 1 - window] > window - 2


def text_windows(text: str | None, window: int, short: tuple[int, ...], item: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, dict[int, str], int]], int, int]:
    """(hashes, positions, slots, words in a window) of a text's windows, and how many windows and words it has.

    short: lengths of items below ``window``. An item shorter than that has one window, all its words.
    """
    plain, first, second = templates(text)
    n = len(plain)
    if not n:
        return [], 0, 0
    if n < window and (item or n < LEAST_WORDS):
        return [(_windows(plain, n), np.zeros(1, np.int64), {}, n)], 1, n
    found = [(_windows(plain, m), np.arange(n - m + 1), {}, m) for m in short if LEAST_WORDS <= m <= n and not item]
    if n < window:
        return found, 0, n
    every = np.arange(n - window + 1)
    none = np.zeros(len(every), bool)
    only = _mostly_slots(first[1] | second[1], n, window) if first[1] or second[1] else none
    counted = every if not item or only.all() else every[~only]
    found.append((_windows(plain, window)[counted], counted, {}, window))
    for h, slots in (first, second):
        if slots:
            at = every[~(_mostly_slots(slots, n, window) | (only if item else none))]
            found.append((_windows(h, window)[at], at, slots, window))
    return found, len(counted), n


def window_table(texts: DataFrame, id_col: str, window: int = WINDOW, keep: np.ndarray | None = None, short: tuple[int, ...] = (), item: bool = False, key: Column | None = None) -> DataFrame:
    """id, key (the row's number), win (hash), pos, n_windows and n_words of the text, and slots: the positions and fillers inside the window.

    keep: a bit map of 1 << MAP_BITS bits; windows whose top bits are not set in it are dropped.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared is not None else None
        for b in batches:
            rows, wins, pos, total, length, keys, values = [], [], [], [], [], [], []
            for k, t in enumerate(b.column("text").to_pylist()):
                found, n_windows, n_words = text_windows(t, window, short, item)
                for win, at, slots, size in found:
                    if bits is not None and len(win):
                        place = (win >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                        kept_ = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                        win, at = win[kept_], at[kept_]
                    for p in at.tolist():
                        inside = [i for i in range(p, p + size) if i in slots] if slots else []
                        keys.append(inside)
                        values.append([slots[i] for i in inside])
                    rows += [k] * len(at)
                    wins.append(win)
                    pos.append(at)
                    total += [n_windows] * len(at)
                    length += [n_words] * len(at)
                if len(rows) > 100_000 or rows and k == b.num_rows - 1:
                    cols = [b.column("id").take(pa.array(rows)), b.column("key").take(pa.array(rows)), pa.array(np.concatenate(wins).view(np.int64)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(total, pa.int32()), pa.array(length, pa.int32()), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "key", "win", "pos", "n_windows", "n_words", "slot_at", "slot_text"])
                    rows, wins, pos, total, length, keys, values = [], [], [], [], [], [], []

    key = F.monotonically_increasing_id() if key is None else key
    return texts.select(F.col(id_col).alias("id"), key.alias("key"), "text").mapInArrow(released(cut), f"id {kind}, key long, win long, pos int, n_windows int, n_words int, slot_at array<int>, slot_text array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_similarity: float = MIN_SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, n_changed (slots filled otherwise), exact and at (its first word) of every leak."""
    return _leaks(docs, benchmark, None, window, min_similarity, broadcast_windows).drop("doc_key", "item_key")


def _leaks(docs: DataFrame, benchmark: DataFrame, doc_key: Column | None, window: int = WINDOW, min_similarity: float = MIN_SIMILARITY, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``find_leaks`` with the numbers of the rows: ``doc_key``, or else any."""
    items = staged(window_table(benchmark.where("text is not null"), "item_id", window, item=True), "item-windows")
    n = items.count()
    short = tuple(sorted(r[0] for r in items.where(F.col("n_words").between(LEAST_WORDS, window - 1)).select("n_words").distinct().collect()))  # fewer than window rows
    keep = None
    if n <= broadcast_windows:
        keep = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        top = items.select(F.shiftrightunsigned("win", 64 - MAP_BITS).cast("int").alias("top")).distinct().toPandas()["top"].to_numpy()
        np.bitwise_or.at(keep, top >> 3, (1 << (top & 7)).astype(np.uint8))
    own = window_table(docs, "doc_id", window, keep, short, key=doc_key)
    theirs = items.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("win").alias("_win"), F.col("pos").alias("item_pos"), F.col("n_windows").alias("item_windows"), F.col("n_words").alias("item_words"), F.col("slot_text").alias("item_slots"))
    theirs = F.broadcast(theirs) if keep is not None else theirs
    hits = own.join(theirs, F.col("win") == F.col("_win"))
    # regions of twice the item's length, one beginning at each multiple of it: an item with something put in is in one
    region = F.floor(F.col("pos") / F.col("item_words")).cast("int")
    hits = hits.select(F.col("id").alias("doc_id"), F.col("key").alias("doc_key"), "item_id", "item_key", "pos", "item_pos", "item_windows", "slot_at", "slot_text", "item_slots", F.explode(F.array(region, region - 1)).alias("region"))
    hits = staged(hits, "hits")  # used twice below; the texts are read once
    key = ["doc_key", "item_key", "region"]
    cover = hits.groupBy(*key).agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.count_distinct("item_pos").alias("hit"), F.max("item_windows").alias("of"), F.min("pos").alias("at"))
    # a window that the item has more than once is taken at the place to which most hits of the region are shifted alike
    shift = F.col("pos") - F.col("item_pos")
    alike = hits.withColumn("shift", shift).withColumn("alike", F.count("*").over(Window.partitionBy(*key, "shift")))
    alike = alike.withColumn("rank", F.rank().over(Window.partitionBy(*key, "pos").orderBy(F.col("alike").desc(), "shift"))).where("rank = 1")
    # one vote per slot of a region: (item's filler, document's filler)
    votes = alike.where(F.size("slot_at") > 0).select(*key, F.explode(F.arrays_zip("slot_at", "slot_text", "item_slots")).alias("s"))
    votes = votes.select(*key, F.col("s.slot_at").alias("place"), F.col("s.item_slots").alias("theirs"), F.col("s.slot_text").alias("ours")).distinct()
    pairs = votes.groupBy(*key, "theirs", "ours").agg(F.count("*").alias("n"))
    # a region's slots are few: at most its words
    many = lambda side: F.count("*").over(Window.partitionBy(*key, side)) > 1
    torn = pairs.withColumns({"torn_theirs": many("theirs"), "torn_ours": many("ours")})
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    filled = torn.groupBy(*key).agg(
        F.sum("n").alias("n_slots"), sum_if(F.col("ours") != F.col("theirs")).alias("n_changed"), F.greatest(sum_if(F.col("torn_theirs")), sum_if(F.col("torn_ours"))).alias("torn")
    )
    zero = F.lit(0).cast("long")
    covered = cover.where(F.col("hit") >= F.ceil(F.col("of") * min_similarity))
    found = covered.join(filled.withColumnsRenamed({k: f"_{k}" for k in key}), [F.col(k) == F.col(f"_{k}") for k in key], "left")
    found = found.select("doc_id", "item_id", "doc_key", "item_key", (F.col("hit") / F.col("of")).alias("coverage"), F.coalesce("n_slots", zero).alias("n_slots"), F.coalesce("n_changed", zero).alias("n_changed"), F.coalesce("torn", zero).alias("torn"), "at")
    # consistent: a filler nearly always stands for one filler, both ways
    found = found.where(F.col("torn") <= (1 - min_similarity) * F.col("n_slots"))
    best = found.groupBy("doc_key", "item_key").agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.max(F.struct("coverage", (-F.col("n_changed")).alias("k"), "n_slots", (-F.col("at")).alias("a"))).alias("b"))
    return best.select("doc_key", "item_key", "doc_id", "item_id", "b.coverage", "b.n_slots", (-F.col("b.k")).alias("n_changed"), (F.col("b.k") == 0).alias("exact"), (-F.col("b.a")).alias("at"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that leak no item.

    Rows are told apart by a number that is written with them. The leaking ones' numbers are slim; texts move only if there are too many to broadcast.
    """
    key, leak = free("row_key", docs), free("row_leak", docs)
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")
    gone = staged(_leaks(rows.select("doc_id", "text", named(key).alias("key")), benchmark, F.col("key"), **settings).select(F.col("doc_key").alias(leak)).distinct(), "leaks")
    if gone.count() <= BROADCAST_LEAKS:
        gone = F.broadcast(gone)
    return rows.join(gone, named(key) == named(leak), "left_anti").select(*all_columns(docs))
