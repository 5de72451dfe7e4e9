"""Removal of repeated passages: fixed-block anchors, rolling probes, exact windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultloom.llm.common import gram_hashes, ship, staged, text_slices, word_hashes, words_of
from faultloom.llm.exact_dedup import KEY, exact_groups, with_digests

#: Words whose windows a task packs together.
PART_WORDS = 2_000_000
#: Words a bucket of windows or a slot of documents is meant to hold; their number follows from the corpus.
BUCKET_WORDS = 2_500_000

#: Entries of one destination: runs of a document (identifier and row hash, number of entries), then of every
#: entry its place (low and high halves of 32 bits) and code. sure: the places are known to repeat.
PACKED = pa.schema([("dest", pa.int32()), ("sure", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()),
                    ("places", pa.binary()), ("codes", pa.binary())])
PACKED_DDL = "dest int, sure boolean, ids binary, counts binary, places binary, codes binary"


def _pack(dest: np.ndarray, sure: bool, doc: np.ndarray, ids: np.ndarray, place: np.ndarray, codes: np.ndarray) -> list[tuple]:
    """Packed rows of entries; of equal destination, they stay in the order given."""
    if not len(dest):
        return []
    order = np.argsort(dest, kind="stable")
    dest, doc, place, codes = dest[order], doc[order], place[order].astype(np.uint32), codes[order]
    cuts = np.flatnonzero(np.concatenate(([True], dest[1:] != dest[:-1])))
    ends = np.append(cuts[1:], len(dest))
    out = []
    for a, b in zip(cuts, ends):
        d = doc[a:b]
        starts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        counts = np.diff(np.append(starts, b - a)).astype(np.uint32)
        halves = np.ascontiguousarray(place[a:b]).view(np.uint16).reshape(-1, 2).T
        out.append((int(dest[a]), sure, ids[d[starts]].tobytes(), counts.tobytes(), halves.tobytes(), codes[a:b].tobytes()))
    return out


def _unpack(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids (n, 2), document index and place of every entry, codes (n, width) bytes."""
    ids = np.frombuffer(b"".join(frame["ids"]), np.int64).reshape(-1, 2)
    counts = np.frombuffer(b"".join(frame["counts"]), np.uint32)
    places = [np.frombuffer(p, np.uint16).reshape(2, -1) for p in frame["places"]]
    place = np.concatenate([p[0].astype(np.int64) + (p[1].astype(np.int64) << 16) for p in places] or [np.zeros(0, np.int64)])
    codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(-1, width) if width else None
    return ids, np.repeat(np.arange(len(ids)), counts), place, codes


def _slot(ids: np.ndarray, slots: int) -> np.ndarray:
    return np.mod(ids[:, 1], slots).astype(np.int32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(PACKED.names, map(list, zip(*rows)))) if rows else {n: [] for n in PACKED.names}, schema=PACKED)


def _parts(batches: Iterator[pa.RecordBatch], seeds: tuple[int, ...], limit: int):
    """Consecutive documents with about `limit` words: (identifiers and row hashes, words per document, hashes of every word)."""
    ids, counts, hashes, held = [], [], [], 0
    for batch in batches:
        names = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(np.int64)
        for first, end, data, bounds in text_slices(batch.column(2)):
            start, stop, row = words_of(data, bounds)
            ids.append(names[first:end])
            counts.append(np.bincount(row, minlength=end - first))
            hashes.append([word_hashes(data, start, stop, s) for s in seeds])
            held += len(start)
            if held >= limit:
                yield np.concatenate(ids), np.concatenate(counts), [np.concatenate(h) for h in zip(*hashes)]
                ids, counts, hashes, held = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(counts), [np.concatenate(h) for h in zip(*hashes)]


def _windows(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first word, document and place of every window of n words that lies in one document."""
    doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return at, doc[at], at - first[doc[at]]


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Whether an entry of a sorted array begins a new value."""
    return np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, bool)


def _probes(block: int, buckets: int):
    """Every rolling window of `block` words, sent to the bucket of its hash.

    The code of an entry is 30 bits of the hash, then whether the window repeats within the part, then whether
    it is an indexed reference block (its place is a multiple of the block length). Of a window that repeats
    within the part one entry is sent to the bucket; its other places are known to repeat and go straight on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, counts, (words,) in _parts(batches, (0,), PART_WORDS):
            at, doc, place = _windows(counts, block)
            h = gram_hashes(words, block)[at]
            order = np.argsort(h, kind="stable")
            new = _groups(h[order])
            of = np.cumsum(new) - 1
            size = np.bincount(of)
            anchored = np.bincount(of, weights=(place[order] % block == 0)) > 0
            lead = order[new]
            rest = np.sort(order[~new])
            code = ((h[lead] & np.uint64((1 << 30) - 1)) << np.uint64(2)).astype(np.uint32) | ((size > 1).astype(np.uint32) << np.uint32(1)) | anchored.astype(np.uint32)
            back = np.argsort(lead, kind="stable")
            lead, code = lead[back], code[back]
            bucket = ((h[lead] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            yield _batch(_pack(bucket, False, doc[lead], ids, place[lead], code)
                         + _pack(_slot(ids, buckets)[doc[rest]], True, doc[rest], ids, place[rest], np.zeros((len(rest), 0), np.uint8)))

    return run


def _hits(buckets: int):
    """Of one bucket, the places of windows that equal an indexed block and occur at least twice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        probes = frame[~frame["sure"]]
        ids, doc, place, codes = _unpack(probes, 4)
        codes = codes.copy().view(np.uint32).ravel()
        h = codes >> np.uint32(2)
        order = np.argsort(h, kind="stable")
        of = np.cumsum(_groups(h[order])) - 1
        seen = codes[order]
        anchored = np.bincount(of, weights=seen & 1) > 0
        twice = (np.bincount(of) > 1) | (np.bincount(of, weights=seen & 2) > 0)
        hit = np.sort(order[(anchored & twice)[of]]) if len(h) else order
        rows = _pack(_slot(ids, buckets)[doc[hit]], True, doc[hit], ids, place[hit], np.zeros((len(hit), 0), np.uint8))
        return pd.concat([frame[frame["sure"]], pd.DataFrame(rows, columns=PACKED.names)], ignore_index=True)

    return run


def _gone(buckets: int):
    """Rows that go whole, packed by slot without places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.int64)
            slot = _slot(ids, buckets)
            order = np.argsort(slot, kind="stable")
            cuts = np.flatnonzero(_groups(slot[order]))
            yield _batch([(int(slot[s[0]]), False, ids[s].tobytes(), b"", b"", b"") for s in np.split(order, cuts[1:]) if len(s)])

    return run


def _places_by_row(packed: pd.DataFrame) -> dict[tuple[int, int], np.ndarray]:
    ids, doc, place, _ = _unpack(packed, 0)
    if not len(doc):
        return {}
    key = np.unique(ids, axis=0, return_inverse=True)
    of = key[1].ravel()[doc]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(key[0]) + 1))
    return {tuple(map(int, k)): place[order[a:b]] for k, a, b in zip(key[0], cuts, cuts[1:])}


def _marks(places: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of n words or windows, those covered by intervals of `width` from the given places."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.clip(places, 0, n), 1)
    np.add.at(steps, np.clip(places + width, 0, n), -1)
    return np.cumsum(steps)[:n] > 0


def _candidates(window: int, block: int, buckets: int):
    """Cogrouped by slot: extends hits to the windows of full length that contain one, sent by their 128-bit hash.

    A window that repeats within the group goes to its bucket once, with its first place; all later places
    repeat an earlier one and are known to go.
    """

    def run(docs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        found = _places_by_row(hits[hits["sure"]])
        gone = {tuple(map(int, k)) for b in hits.loc[~hits["sure"], "ids"] for k in np.frombuffer(b, np.int64).reshape(-1, 2)}
        docs = docs[[k in found and k not in gone for k in zip(docs["id"], docs["uid"])]].drop_duplicates(["id", "uid"])
        out: list[tuple] = []
        source = iter([pa.RecordBatch.from_pandas(docs[["id", "uid", "t"]], preserve_index=False)] if len(docs) else [])
        for ids, counts, words in _parts(source, (0, 1), 4 * BUCKET_WORDS):
            at, doc, place = _windows(counts, window)
            first = np.cumsum(counts) - counts
            keep = np.zeros(int(counts.sum()) + 1, bool)
            for k, (row, n) in enumerate(zip(ids, counts)):
                p = found[tuple(map(int, row))]
                keep[first[k] : first[k] + n] = _marks(p - (window - block), window - block + 1, int(n))
            chosen = keep[at]
            at, doc, place = at[chosen], doc[chosen], place[chosen]
            h1, h2 = (gram_hashes(w, window, s)[at] for w, s in zip(words, (0, 1)))
            order = np.lexsort((place, ids[doc, 0], h2, h1))
            new = _groups(h1[order]) | _groups(h2[order])
            lead = np.sort(order[new])
            same = np.flatnonzero(~new)
            first_of = order[new][np.cumsum(new) - 1]
            # A row that repeats the identifier of the first place at the same place is not later than it.
            tied = (ids[doc[order], 0] == ids[doc[first_of], 0]) & (place[order] == place[first_of])
            late = np.sort(order[same[~tied[same]]])
            lead = np.sort(np.concatenate((lead, order[same[tied[same]]])))
            code = np.stack((h1[lead], h2[lead]), axis=1)
            out += _pack((h1[lead] % np.uint64(buckets)).astype(np.int32), False, doc[lead], ids, place[lead], code)
            out += _pack(_slot(ids, buckets)[doc[late]], True, doc[late], ids, place[late], np.zeros((len(late), 0), np.uint8))
        return pd.DataFrame(out, columns=PACKED.names)

    return run


def _later(buckets: int):
    """Of one bucket, the places of windows whose word sequence also starts earlier."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, doc, place, codes = _unpack(frame[~frame["sure"]], 16)
        h = codes.copy().view(np.uint64)
        order = np.lexsort((place, ids[doc, 0], h[:, 1], h[:, 0])) if len(doc) else np.zeros(0, np.int64)
        new = _groups(h[order, 0]) | _groups(h[order, 1])
        first = order[new][np.cumsum(new) - 1]
        tied = (ids[doc[order], 0] == ids[doc[first], 0]) & (place[order] == place[first])
        late = np.sort(order[~tied])
        rows = _pack(_slot(ids, buckets)[doc[late]], True, doc[late], ids, place[late], np.zeros((len(late), 0), np.uint8))
        return pd.concat([frame[frame["sure"]], pd.DataFrame(rows, columns=PACKED.names)], ignore_index=True)

    return run


def _kept(window: int):
    """Cogrouped by slot: every document with its words counted and the covered ones removed."""

    def run(docs: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        found = _places_by_row(removed[removed["sure"]])
        gone = {tuple(map(int, k)) for b in removed.loc[~removed["sure"], "ids"] for k in np.frombuffer(b, np.int64).reshape(-1, 2)}
        out = []
        for id_, uid, text, null in zip(docs["id"], docs["uid"], docs["t"], docs["no_id"]):
            words = text.encode("utf-8", "surrogatepass").split()
            n, key = len(words), (id_, uid)
            if key in gone and n >= window:
                keep: list = []
            elif key in found:
                keep = [w for w, x in zip(words, _marks(found[key], window, n)) if not x]
            else:
                keep = words
            kept = b" ".join(keep)
            out.append((None if null else id_, n, n - len(keep), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if `texts`, kept_text.

    A word goes if a window of `window` consecutive words that covers it also starts earlier, in a document of
    smaller identifier or before it in the same one; windows are judged on the input. Kept words are joined by
    one space.

    Any repeated window of 2 * block words or one less contains a whole block of `block = window // 2` words at
    a multiple of `block` in each of its occurrences. Such blocks are the index. Every rolling window of `block`
    words probes it, in buckets by hash; the places found are extended to the full windows that contain them,
    and among these, again in buckets by a 128-bit hash of the words, all but the first go. Neighbouring
    windows of a maximal repeat go together, so their union is the maximal exact repeat. Later copies of equal
    texts go whole, without sending their windows.

    Entries travel packed by destination; the number of buckets follows from the words of the corpus. A window
    that repeats within a task is sent once from there, so the most frequent passage costs a bucket one entry
    a task.

    NULL texts have no words; a NULL identifier counts as the largest. Rows that repeat an identifier are
    judged one by one as the same document: equal places are not earlier than each other. Other columns are
    ignored. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    block = window // 2
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.col(id_col).isNull().alias("no_id"), text.alias("t"))
    rows = rows.withColumn("uid", F.xxhash64("id", "t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    buckets = max(32, int(chars / 6 / BUCKET_WORDS) + 1)
    slot = F.pmod(F.col("uid"), F.lit(buckets)).cast("int")

    copies = with_digests(rows, F.col("t")).select("id", "uid", *KEY).join(
        staged(exact_groups(rows, "id", "t")), list(KEY)).where(F.col("id") != F.col("keep_id"))
    gone = copies.select("id", "uid").mapInArrow(_gone(buckets), PACKED_DDL)
    packed = rows.select("id", "uid", "t").mapInArrow(_probes(block, buckets), PACKED_DDL)
    hits = staged(packed.groupBy("dest").applyInPandas(_hits(buckets), PACKED_DDL).unionByName(gone))
    by_slot = rows.withColumn("slot", slot)
    windows = by_slot.select("slot", "id", "uid", "t").groupBy("slot").cogroup(hits.groupBy("dest")).applyInPandas(
        _candidates(window, block, buckets), PACKED_DDL)
    removed = windows.groupBy("dest").applyInPandas(_later(buckets), PACKED_DDL)
    removed = staged(removed.unionByName(hits.where(~F.col("sure"))))
    out = by_slot.groupBy("slot").cogroup(removed.groupBy("dest")).applyInPandas(
        _kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if texts else out.drop("kept_text")
