"""Where flows begin: packets of one key in order, whole groups at a time.

A key's packets are cut into parts by index. A flow begins with the key's first packet, after an idle gap, and in a finished TCP flow (reset, or FIN
of both sides) at a SYN without ACK or after a short gap. Whether a flow is finished depends on where it began; what a part does
is therefore taken for each state in which it can be entered (``exits``), a key's parts are put one after the other (``entries``), and
each part is then walked from its true state (``starts``). Within a part, arrays of the next reset, FIN and boundary lead from one
start to the next; no step is taken per packet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

FIN, SYN, RST, ACK = 1, 2, 4, 16
#: States in which a part is entered: its first packet begins a flow, or goes on with one that has no TCP header, has seen no FIN, the FIN of a or
#: of b, or is finished.
BEGINS, PLAIN, OPEN, FIN_A, FIN_B, DONE = range(6)
BASES = ["first_packet", "tcp_syn", "tcp_syn_ack"]


@dataclass(frozen=True)
class Idle:
    tcp: int
    other: int
    linger: int


class Part:
    """The packets of one or several groups, as arrays; ``new`` marks the first of each group."""

    def __init__(self, batch: pa.RecordBatch, new: np.ndarray, last: np.ndarray, idle: Idle):
        column = lambda c: np.asarray(batch.column(c).fill_null(-1))
        self.n, self.new, self.index = batch.num_rows, new, column("packet_index")
        self.flags, self.from_a = column("flags"), np.asarray(batch.column("from_a")).astype(bool)
        clock, self.reached = column("clock"), column("reached").copy()
        # a confirmed time lies ahead of the clock until the packet that confirms it
        for i in np.flatnonzero(self.reached > clock).tolist():
            j = i + 1
            while j < self.n and not new[j] and self.reached[j] < self.reached[i]:
                self.reached[j] = self.reached[i]
                j += 1
        before = np.zeros(self.n, np.int64)
        before[new] = last
        for k in np.flatnonzero(last > self.reached[new]).tolist():
            i = int(np.flatnonzero(new)[k])
            while self.reached[i] < last[k]:
                self.reached[i] = last[k]
                i += 1
                if i == self.n or new[i]:
                    break
        before[1:] = np.where(new[1:], before[1:], self.reached[:-1])
        self.gap = clock - before
        tracked = self.flags >= 0
        flag = lambda mask: tracked & (self.flags & mask != 0)
        self.opening = tracked & (self.flags & (SYN | ACK) == SYN)
        self.answer = tracked & (self.flags & (SYN | ACK) == SYN | ACK)
        self.tracked = tracked
        self.limit = np.where(column("protocol") == 6, idle.tcp, idle.other)
        self.late = self.gap > idle.linger
        following = lambda mark: np.append(np.minimum.accumulate(np.where(mark, np.arange(self.n), self.n)[::-1])[::-1], self.n)
        self.reset, self.fin_a, self.fin_b = following(flag(RST)), following(flag(FIN) & self.from_a), following(flag(FIN) & ~self.from_a)
        self.boundary = following(self.opening | self.late)

    def finish(self, at: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The packet that finishes the flow which is in ``state`` before packet ``at``, or n."""
        both = np.where(state == FIN_A, self.fin_b[at], np.where(state == FIN_B, self.fin_a[at], np.maximum(self.fin_a[at], self.fin_b[at])))
        return np.where(state == PLAIN, self.n, np.where(state == DONE, at - 1, np.minimum(self.reset[at], both)))

    def follow(self, at: np.ndarray, state: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Marks of all packets that begin a flow after those at ``at``, each up to its ``end``."""
        marks = np.zeros(self.n, bool)
        while len(at):
            done = self.finish(at, state)
            after = self.boundary[np.minimum(done + 1, self.n)]
            go = (done < end) & (after < end)
            at, end = after[go], end[go]
            marks[at] = True
            state = np.where(self.tracked[at], OPEN, PLAIN)
        return marks

    def own_state(self, at: np.ndarray) -> np.ndarray:
        return np.where(self.tracked[at], OPEN, PLAIN)


def _grouped(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of equal (key, part), ``least`` rows together or more; and the first row of each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def send() -> tuple[pa.RecordBatch, np.ndarray]:
        whole = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole, _firsts(whole)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size >= least:
            # up to the last group that is sure to be whole
            first = _firsts(batch)
            cut = 0 if _differ(held[-1], batch) else int(np.flatnonzero(np.append(first[1:], True))[0]) + 1
            if cut < batch.num_rows or cut == 0:
                if cut:
                    held.append(batch.slice(0, cut))
                yield send()
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield send()


def _differ(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return a.column("key")[a.num_rows - 1] != b.column("key")[0] or a.column("part")[a.num_rows - 1] != b.column("part")[0]


def _firsts(batch: pa.RecordBatch) -> np.ndarray:
    import pyarrow.compute as pc

    new = np.ones(batch.num_rows, bool)
    for c in ("key", "part"):
        column = batch.column(c)
        same = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = same if c == "key" else new[1:] | same
    return new


ROWS = 1 << 16
ENTRY = ["state", "reached", "first_packet", "a_began", "basis"]


def starts(idle: Idle):
    """Every row (column ``row``) with ``first_packet``, whether endpoint a is the initiator, and the basis of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, new in _grouped(batches, ROWS):
            entry = {c: np.asarray(batch.column(f"in_{c}").fill_null(0)) for c in ENTRY}
            first = np.flatnonzero(new)
            p = Part(batch, new, entry["reached"][first], idle)
            state = entry["state"][first]
            at_once = (state == BEGINS) | (p.gap[first] > p.limit[first]) | ((state == DONE) & (p.opening[first] | p.late[first]))
            begins = (p.gap > p.limit) & ~new
            begins[first] = at_once
            cuts = np.union1d(first, np.flatnonzero(begins))
            ends = np.append(cuts[1:], p.n)
            entered = np.where(begins[cuts], p.own_state(cuts), 0)
            entered[~begins[cuts]] = state[np.searchsorted(first, cuts[~begins[cuts]])]
            begins |= p.follow(cuts, entered, ends)
            group = np.cumsum(new) - 1
            at = np.maximum.accumulate(np.where(begins, np.arange(p.n), -1))
            own = at >= first[group]
            at = np.maximum(at, 0)
            out = {
                "first_packet": np.where(own, p.index[at], entry["first_packet"][first][group]),
                "a_began": np.where(own, p.from_a[at] ^ p.answer[at], entry["a_began"][first][group].astype(bool)),
                "basis": np.where(own, np.where(p.opening[at], 1, np.where(p.answer[at], 2, 0)), entry["basis"][first][group]),
            }
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out["first_packet"], pa.int64()), pa.array(out["a_began"].astype(bool)), pa.array(out["basis"], pa.int32())], ["row", *out])

    return run


EXITS = ["key", "part", "clock", "opening", "limit", "reached", "states", "firsts", "a_began", "bases"]
EXIT_TYPES = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4]
EXIT_SCHEMA = "key binary, part bigint, clock bigint, opening boolean, limit bigint, reached bigint, states array<bigint>, firsts array<bigint>, a_began array<bigint>, bases array<bigint>"


def exits(idle: Idle):
    """One row per (key, part): for each state of entry the state that it is left in, and the flow that goes on, -1 for the one that came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, new in _grouped(batches, ROWS):
            cuts, found = np.append(np.flatnonzero(new), whole.num_rows), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(int(a), int(b - a))
                alone = np.zeros(batch.num_rows, bool)
                alone[0] = True
                p = Part(batch, alone, np.asarray(batch.column("clock"))[:1], idle)
                gaps = np.flatnonzero((p.gap > p.limit) & ~alone)
                rows = []
                for state in range(6):
                    cut = np.append(0, gaps)
                    began = np.array([p.own_state(np.array([0]))[0] if state == BEGINS else state, *p.own_state(gaps)])
                    marks = p.follow(cut, began, np.append(gaps, p.n)) if state != DONE else p.follow(cut[1:], began[1:], np.append(gaps, p.n)[1:])
                    if state == DONE:  # the first packet doesn't begin a flow, a later boundary before the first gap may
                        end = gaps[0] if len(gaps) else p.n
                        after = p.boundary[min(1, p.n)]
                        if after < end:
                            marks |= p.follow(np.array([after]), p.own_state(np.array([after])), np.array([end]))
                            marks[after] = True
                    marks[gaps] = True
                    marks[0] |= state == BEGINS
                    last = int(np.flatnonzero(marks)[-1]) if marks.any() else -1
                    at, now = np.array([max(last, 0)]), np.array([p.own_state(np.array([last]))[0] if last >= 0 else state])
                    left = int(now[0])
                    if left != PLAIN:
                        if int(p.finish(at, now)[0]) < p.n:
                            left = DONE
                        elif left == OPEN:
                            left = FIN_A if p.fin_a[at[0]] < p.n else FIN_B if p.fin_b[at[0]] < p.n else OPEN
                    rows.append((left, int(p.index[last]) if last >= 0 else -1, int(p.from_a[last] ^ p.answer[last]), 1 if p.opening[last] else 2 if p.answer[last] else 0))
                clock = int(np.asarray(batch.column("clock"))[0])
                found.append((batch.column("key")[0].as_py(), batch.column("part")[0].as_py(), clock, bool(p.opening[0]), int(p.limit[0]), int(p.reached.max()), *[list(x) for x in zip(*rows, strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), EXIT_TYPES, strict=True)], EXITS)

    return run


ENTRY_SCHEMA = "key binary, part bigint, in_state bigint, in_reached bigint, in_first_packet bigint, in_a_began bigint, in_basis bigint"


def entries(idle: Idle):
    """A key's parts in order, one row each: the state in which each is entered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["key"] != key:
                    key, now = r["key"], None
                if now is None:
                    state, flow, reached = BEGINS, (0, 0, 0), 0
                else:
                    state, flow, reached = now
                gap = r["clock"] - reached
                begins = state == BEGINS or gap > r["limit"] or (state == DONE and (r["opening"] or gap > idle.linger))
                out.append((key, r["part"], state, reached, *flow))
                k = BEGINS if begins else state
                own = (r["firsts"][k], r["a_began"][k], r["bases"][k])
                now = (r["states"][k], flow if own[0] < 0 else own, max(reached, r["reached"]))
            types = [pa.binary(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], [x.split()[0] for x in ENTRY_SCHEMA.split(", ")])

    return run
