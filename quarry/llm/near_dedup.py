"""Near-duplicates: universal hash minima, banding, verification, components.

1. A text's set holds the hashes of its distinct five-word shingles.  Texts of
   equal sets are one *set* from here on, under its least doc_id, so copies are
   never expanded.
2. Each set has 128 minima, each under its own universal hash (multiply-shift), in 32
   bands of four: sets with similarity 0.75 share no band about once in 200,000 pairs.
3. Sets that share a band are candidates.  In buckets of at most ``small`` sets
   every pair is one; larger buckets first compare every set with the bucket's
   least one only.
4. Candidates whose signatures agree too rarely are dropped (the bound lies five
   standard errors below the threshold); the rest is confirmed on full sets.
   Only pairs between sets that are not yet connected need confirming: first one
   pair a set, then what still lies across.
5. Components are found by large-star and small-star.
6. In larger buckets whose sets did not all meet in one component, sets outside
   are first compared with the bucket's *hub*, the set with the most widespread
   shingles, and then, still across components only, with every set that can be
   near enough: those that share a shingle of at most ``RARE`` sets, met on that
   shingle, and those that are near without one.  The latter are few: what two
   sets have in common lies in the hub or is widespread outside it, which
   bounds their intersection, so the join is on the hub's component and a band
   of sizes.  This loses no pair, and a group of copies edited apart never
   meets itself.

A bucket, a pivot, a hub and a group of copies may each hold a third of all
rows: joins on them that carry signatures or sets go through ``unique_join``,
which splits such keys; those of bare ids are left to AQE.

Full sets are sets of 64-bit shingle hashes: two different shingles of a pair
agree with probability 2**-64, so no result depends on the minima.  (Words
built to collide, such as Thue-Morse strings of a thousand letters, can.)

Null and empty texts, and those of white space only, have empty sets and no
links.  Rows with a null id get the component of their set if one of its rows
has an id, else null.  Repeated rows are copies.  Empty tables give empty
results.  Of equally widespread sets the one of the least id is a hub.  Very long
texts are read whole.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_WORDS, bounded_batches, byte_view, mix64, prefix_hashes, semi_join_ids, span_hashes, steps, unique_join, word_spans, write_shared
from quarry.llm.components import components

WORDS = 5
MINIMA, BANDS = 128, 32
ROWS = MINIMA // BANDS
#: A shingle of at most so many sets of mixed buckets is rare.
RARE = 16
_DRAW = np.random.default_rng(75)
#: Multiply-shift: h(x) = (a * x + b mod 2**64) >> 32 with a, b below 2**64 is pairwise independent for 32-bit x.
_A = _DRAW.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_B = _DRAW.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_PLACE = _DRAW.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the offsets of each text's part."""
    inside, value = SPACE_WORDS
    n = len(offsets) - 1
    starts, ends, row = word_spans(data, offsets, inside)
    words = span_hashes(prefix_hashes(data, value), starts, ends)
    at = np.searchsorted(row, np.arange(n + 1))
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole += words[k : k + len(whole)] * _PLACE[k]
    whole = mix64(whole)
    parts = []
    for i in range(n):
        first, count = int(at[i]), int(at[i + 1] - at[i])
        if count >= width:
            parts.append(np.unique(whole[first : first + count - width + 1]))
        elif count:
            short = (words[first : first + count] * _PLACE[:count]).sum(dtype=np.uint64) + np.uint64(count)
            parts.append(mix64(np.array([short])))
        else:
            parts.append(np.zeros(0, np.uint64))
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(sizes)])


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x 128 minima; an empty set has the greatest value throughout."""
    out = np.full((len(offsets) - 1, MINIMA), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        x, heads, drawn = hashes >> np.uint64(32), offsets[some], np.empty(len(hashes), np.uint64)
        for k in range(MINIMA):
            np.multiply(x, _A[k], out=drawn)
            drawn += _B[k]
            out[some, k] = np.minimum.reduceat(drawn, heads) >> np.uint64(32)
    return out


_SETS = "doc_id long, n_shingles long, set_key binary, signature binary"


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        hashes, at = shingle_sets(*byte_view(batch.column(1)))
        minima = signatures(hashes, at)
        keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        signs = [None if k is None else m.tobytes() for k, m in zip(keys, minima, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, signature) to (rep, band), one row for each of the 32 bands."""
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if not batch.num_rows:
            continue
        minima = np.frombuffer(byte_view(batch.column(1))[0].tobytes(), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        band = np.broadcast_to(salt, minima.shape[:2]).copy()
        for k in range(ROWS):
            band = mix64(band ^ minima[:, :, k])
        reps = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(band.reshape(-1).view(np.int64))], ["rep", "band"])


def _all_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the sets in one small bucket."""
    for batch in batches:
        a, b = [], []
        for reps in batch.column(0).to_pylist():
            reps = sorted(reps)
            for i, x in enumerate(reps):
                a += [x] * (len(reps) - i - 1)
                b += reps[i + 1 :]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike(least: int):
    """Keeps pairs whose signatures agree in at least ``least`` places."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(byte_view(batch.column(k))[0], np.uint32).reshape(-1, MINIMA) for k in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _sets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        hashes, at = shingle_sets(*byte_view(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["rep", "hashes"])


def _tokens_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, token), one row for each shingle of a set."""
    for batch in steps(batches):
        hashes, at = shingle_sets(*byte_view(batch.column(1)))
        reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(at))
        yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(hashes.view(np.int64))], ["rep", "token"])


def _confirm(percent: int):
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, i), (right, j) = byte_view(batch.column(2)), byte_view(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):  # views into the batch: no set is copied
                x, y = left[i[k] : i[k + 1]].view(np.uint64), right[j[k] : j[k + 1]].view(np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = np.intersect1d(x, y, assume_unique=True).size
                    keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


class _Linker:
    """Confirms candidate pairs and keeps the components that they have formed so far."""

    def __init__(self, docs: DataFrame, sets: DataFrame, percent: int, repeated: bool, margin: float = 5.0) -> None:
        self.docs, self.sets, self.percent, self.repeated = docs, sets, percent, repeated
        p = percent / 100
        self.least = int(np.ceil(MINIMA * (p - margin * np.sqrt(p * (1 - p) / MINIMA))))
        self.known: DataFrame | None = None  # (node, component)

    @staticmethod
    def _with_ends(pairs: DataFrame, sides: DataFrame, held: str) -> DataFrame:
        """Written pairs (a, b) with what ``sides`` (rep, held) has of both ends.

        ``a`` is the end that very many pairs may share (a bucket's least set, a hub), so it is split.
        """
        side = lambda end: sides.select(F.col("rep").alias(end), F.col(held).alias(f"{held}_{end}"))
        return unique_join(pairs, side("a"), ["a"], ["b"]).join(side("b"), "b").select("a", "b", f"{held}_a", f"{held}_b")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Candidates (a, b) whose signatures agree well enough."""
        joined = self._with_ends(write_shared(pairs, "candidates"), self.sets, "signature")
        alike = joined.mapInArrow(_alike(self.least), "a long, b long")
        return alike.distinct() if self.repeated else alike  # any texts of two ids may be alike

    def across(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not connected yet."""
        if self.known is None:
            return pairs
        return self._components_of(self._components_of(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")

    def confirm(self, pairs: DataFrame) -> None:
        """Confirm written pairs on full sets and renew the components."""
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        ends = write_shared(ends, "ends")
        full = semi_join_ids(self.docs, ends, "rep").mapInArrow(_sets_of, "rep long, hashes binary")
        if self.repeated:  # any text of an id may confirm its links, but each only once
            full = full.distinct()
        joined = self._with_ends(pairs, write_shared(full, "sets"), "hashes")
        links = joined.mapInArrow(_confirm(self.percent), "a long, b long")
        if self.known is not None:  # each set's link to its component stands for all links before
            links = links.union(self.known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        links = write_shared(links, "confirmed")
        if not links.isEmpty():
            self.known = write_shared(components(links), "components")

    def link(self, pairs: DataFrame, sparing: bool = False) -> None:
        """Confirm what is needed of the candidates: all that lies across, if ``sparing`` one pair a set first."""
        pairs = write_shared(pairs, "alike")
        for single in (True, False) if sparing else (False,):
            left = self.across(pairs)
            if single:
                left = left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            left = write_shared(left, "across")
            if left.isEmpty():
                return
            self.confirm(left)

    def _components_of(self, rows: DataFrame, name: str, out: str) -> DataFrame:
        """Adds the component of a set (itself while it has no links)."""
        if self.known is None:
            return rows.withColumn(out, F.col(name))
        known = self.known.select(F.col("node").alias(name), F.col("component").alias("_c"))
        return rows.join(known, name, "left").withColumn(out, F.coalesce("_c", name)).drop("_c")

    def settle(self, large: DataFrame) -> None:
        """Finds what links the sets of large buckets beyond their least set (step 6)."""
        placed = self._components_of(self._components_of(large.select("band", "rep", "pivot"), "rep", "c"), "pivot", "pc")
        mixed = placed.where("c <> pc").select("band").distinct()
        members = write_shared(placed.join(mixed, "band", "left_semi").select("band", "rep", "c"), "members")
        if members.isEmpty():
            return
        reps = write_shared(members.select("rep").distinct(), "reps")
        tokens = semi_join_ids(self.docs, reps, "rep").mapInArrow(_tokens_of, "rep long, token long")
        tokens = write_shared(tokens.distinct() if self.repeated else tokens, "tokens")
        spread = tokens.groupBy("token").agg(F.count("*").alias("sets"))
        spread = write_shared(tokens.join(spread, "token").withColumn("rare", F.col("sets") <= RARE), "spread")
        frequent = F.collect_list(F.when(~F.col("rare"), F.col("token"))).alias("frequent")
        profiles = write_shared(spread.groupBy("rep").agg(F.avg("sets").alias("common"), F.collect_list("token").alias("tokens"), frequent), "profiles")
        stats = profiles.select("rep", "common")
        hub = F.max_by(F.col("rep"), F.struct("common", -F.col("rep"))).alias("hub")
        hubs = write_shared(members.join(stats, "rep").groupBy("band").agg(hub), "hubs")
        hubbed = members.join(hubs, "band")
        near_hub = self._components_of(hubbed, "hub", "hc").where("c <> hc")
        self.link(self.alike(near_hub.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()))

        members = self._components_of(self._components_of(hubbed.drop("c"), "rep", "c"), "hub", "hc")
        # sets that meet in several buckets of one component meet once
        members = write_shared(members.groupBy("hc", "rep").agg(F.min("c").alias("c")).withColumn("outside", F.col("c") != F.col("hc")), "members")
        if members.where("outside").isEmpty():
            return
        pairs = self._sharing_rare(members, spread)
        if (without := self._near_without(members, profiles)) is not None:
            pairs = pairs.union(without)
        self.link(self.alike(pairs.distinct()))

    @staticmethod
    def _sharing_rare(members: DataFrame, spread: DataFrame) -> DataFrame:
        """Pairs of an outside set and another component's set that share a shingle of few sets."""
        rare = spread.where("rare and sets > 1").select("rep", "token")
        own = members.groupBy("rep").agg(F.min("c").alias("c"), F.bool_or("outside").alias("outside"))
        asking = rare.join(own.where("outside"), "rep").select("token", F.col("rep").alias("x"), F.col("c").alias("cx"))
        met = asking.join(rare.select("token", F.col("rep").alias("y")), "token").where("x <> y").select("x", "cx", "y").distinct()
        met = met.join(own.select(F.col("rep").alias("y"), F.col("c").alias("cy")), "y").where("cx <> cy")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def _near_without(self, members: DataFrame, profiles: DataFrame) -> DataFrame | None:
        """Pairs round one hub that may be near enough although they share no rare shingle, if there can be any.

        Their common shingles lie in the hub, at most as many as either has
        there, or outside it and are not rare; that bounds the intersection.
        Outside sets are bounded first: what is too small for any partner asks nothing.
        """
        need = self.percent / (100 + self.percent)  # of both sizes together
        best = members.where("not outside").join(profiles.select("rep", "common"), "rep").groupBy("hc").agg(F.max_by("rep", F.struct("common", -F.col("rep"))).alias("rep"))
        centre = write_shared(best.join(profiles, "rep").select("hc", F.col("tokens").alias("centre")), "centre")
        sizes, rows = members.groupBy("hc").agg(F.count("*").alias("n")), members.count()

        def bounds(some: DataFrame) -> DataFrame:
            """(hc, rep, c, size, inner, other): one row a set; its shingles stay one array."""
            placed = unique_join(some.join(profiles.drop("common"), "rep"), centre, ["hc"], ["rep"], sizes=sizes, rows=rows)
            if self.repeated:  # texts that share an id are one set here, so nothing bounds what each has
                size, inner, other = F.lit(1), F.lit(1), F.lit(0)
            else:
                size, inner, other = F.size("tokens"), F.size(F.array_intersect("tokens", "centre")), F.size(F.array_except("frequent", "centre"))
            return placed.select("hc", "rep", "c", size.alias("size"), inner.alias("inner"), other.alias("other"))

        high = (F.col("inner") + F.col("other")) / need - F.col("size")  # the largest partner that these shingles allow
        low = F.col("size") * (self.percent / 100)
        asking = write_shared(bounds(members.where("outside")).where(high >= low - 1e-6), "asking")
        if asking.isEmpty():
            return None
        own = write_shared(bounds(members.join(asking.select("hc").distinct(), "hc", "left_semi")), "bounds")
        bin_of = lambda x: F.floor(F.ln(F.greatest(x, F.lit(0.5))) / 0.05).cast("int")
        asking = asking.withColumn("bin", F.explode(F.sequence(bin_of(low - 1e-6), bin_of(high + 1e-6))))
        side = lambda df, x, *keep: df.select("hc", *keep, *(F.col(c).alias(f"{x}_{c}") for c in ("rep", "c", "size", "inner", "other")))
        most = F.least("x_inner", "y_inner") + F.least("x_other", "y_other")
        fits = (F.col("x_c") != F.col("y_c")) & (most >= need * (F.col("x_size") + F.col("y_size")) - 1e-6)
        met = side(asking, "x", "bin").join(side(own.withColumn("bin", bin_of(F.col("size"))), "y", "bin"), ["hc", "bin"]).where(fits)
        return met.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, small: int = 24) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``percent`` is the similarity in hundredths from which two sets are linked;
    buckets of more than ``small`` sets take the way of step 6.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = write_shared(source.mapInArrow(_describe, _SETS), "described")
    # the least id of each set; copies may be a third of all rows, so only aggregates go by set_key
    sets = described.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    sets = write_shared(sets, "distinct")
    signed = described.select("set_key", F.col("doc_id").alias("rep"), "signature").join(sets.where("rep is not null").select("set_key", "rep"), ["set_key", "rep"])
    repeated = not described.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    # two texts under one id are one node, linked by their id alone; each is met under its own signature
    signed = write_shared((signed.dropDuplicates(["set_key"]) if repeated else signed).select("rep", "signature"), "signed")
    bands = signed.mapInArrow(_bands, "rep long, band long")
    bands = write_shared(bands.distinct() if repeated else bands, "bands")
    counts = write_shared(bands.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1"), "counts")
    met = write_shared(unique_join(bands, counts, ["band"], ["rep"], sizes=counts.select("band", "n")).select("band", "rep", "pivot", "n"), "met")
    few = met.where(F.col("n") <= small).groupBy("band").agg(F.collect_list("rep").alias("reps")).select("reps").distinct().mapInArrow(_all_pairs, "a long, b long")
    stars = met.where((F.col("n") > small) & (F.col("rep") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    linker = _Linker(source, signed, percent, repeated)
    linker.link(linker.alike(few.union(stars).distinct()), sparing=True)
    large = met.where(F.col("n") > small)
    if not large.isEmpty():
        linker.settle(large)
    known = linker.known
    placed = sets.select("set_key", "rep")
    if known is not None:
        placed = placed.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        placed = placed.withColumn("component", F.lit(None).cast("long"))
    placed = write_shared(placed.select("set_key", F.coalesce("component", "rep").alias("component")), "set-components")
    joined = unique_join(described.select("doc_id", "n_shingles", "set_key"), placed, ["set_key"], ["doc_id"], "left", sizes=sets.select("set_key", "n"))
    found = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.col("doc_id").isNull() & found.isNull()).alias("kept"))
