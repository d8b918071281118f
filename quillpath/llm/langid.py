"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpath.llm.common import map_arrow, row_slices, utf8

#: Bytes that the network reads at once, from both ends, beginning with an empty state.
SEGMENT = 64
HIDDEN = 8
#: Documents of each language that it is trained on, at most, and segments of each.
DOCUMENTS, SEGMENTS = 400, 8
STEPS, BATCH, RATE = 240, 128, 0.02
#: Segments that are read side by side.
BLOCK = 2048


class Network:
    """Two gated recurrent layers, one from each end. Gates and states are clipped lines, so that a
    byte costs few operations: z, r = clip(., 0, 1); n = clip(x + r * (u h), -1, 1); h += z (n - h).
    Parameters: inputs (2, 256, 3 h) of update, reset and new state; states (2, h, 3 h); out (2 h, languages); bias.
    """

    def __init__(self, inputs: np.ndarray, states: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.inputs, self.states, self.out, self.bias = (np.ascontiguousarray(a, np.float32) for a in (inputs, states, out, bias))

    @classmethod
    def new(cls, languages: int, seed: int = 11) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        inputs = 0.2 * rng.standard_normal((2, 256, 3 * HIDDEN))
        inputs[:, :, : 2 * HIDDEN] += 0.5
        return cls(inputs, 0.3 * rng.standard_normal((2, HIDDEN, 3 * HIDDEN)), 0.3 * rng.standard_normal((2 * HIDDEN, languages)), np.zeros(languages))

    def read(self, segments: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (SEGMENT, rows, 2 h) at every byte of segments (SEGMENT, rows); with keep, what training needs."""
        length, rows = segments.shape
        H = HIDDEN
        states = np.empty((length, rows, 2 * H), np.float32)
        kept: list = []
        for side in (0, 1):
            h = np.zeros((rows, H), np.float32)
            for t in range(length) if side == 0 else range(length - 1, -1, -1):
                x = self.inputs[side].take(segments[t], axis=0)
                u = h @ self.states[side]
                gates = x[:, : 2 * H] + u[:, : 2 * H]
                held = gates.copy() if keep else None
                np.clip(gates, 0, 1, out=gates)
                new = u[:, 2 * H :]
                line = new.copy() if keep else None
                new = new * gates[:, H:]
                new += x[:, 2 * H :]
                bare = new.copy() if keep else None
                np.clip(new, -1, 1, out=new)
                before = h
                h = new - before
                h *= gates[:, :H]
                h += before
                states[t, :, side * H : side * H + H] = h
                if keep:
                    kept.append((side, t, held, gates, line, bare, new, before))
        return states, kept

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states.reshape(-1, 2 * HIDDEN) @ self.out
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*states.shape[:2], -1)

    def gradients(self, segments: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the positions and its gradients, by backpropagation through time."""
        H = HIDDEN
        states, kept = self.read(segments, keep=True)
        p = self.probabilities(states)
        n = mask.sum()
        rows = np.arange(len(labels))
        loss = -(np.log(p[:, rows, labels] + 1e-9) * mask).sum() / n
        d = p
        d[:, rows, labels] -= 1
        d *= (mask / n)[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        g_out, g_bias = states.reshape(-1, 2 * H).T @ flat, flat.sum(axis=0)
        d_states = (flat @ self.out.T).reshape(states.shape)
        g_in, g_state = np.zeros_like(self.inputs), np.zeros_like(self.states)
        carry, last = None, None
        for side, t, held, gates, line, bare, new, before in reversed(kept):
            if side != last:
                carry, last = np.zeros_like(before), side
            dh = d_states[t, :, side * H : side * H + H] + carry
            z, r = gates[:, :H], gates[:, H:]
            d_new = dh * z * (np.abs(bare) < 1)
            d_gate = np.concatenate([dh * (new - before), d_new * line], axis=1) * ((held > 0) & (held < 1))
            d_u = np.concatenate([d_gate, d_new * r], axis=1)
            np.add.at(g_in[side], segments[t], np.concatenate([d_gate, d_new], axis=1))
            g_state[side] += before.T @ d_u
            carry = dh * (1 - z) + d_u @ self.states[side].T
        return float(loss), [g_in, g_state, g_out, g_bias]


def train(segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: int) -> Network:
    """A network fitted by Adam to segments (rows, SEGMENT); every language is drawn equally often."""
    net = Network.new(languages)
    rng = np.random.Generator(np.random.PCG64(5))
    params = [net.inputs, net.states, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = [np.flatnonzero(labels == k) for k in range(languages)]
    place = np.arange(SEGMENT)[:, None]
    for step in range(1, STEPS + 1):
        take = np.concatenate([rng.choice(r, -(-BATCH // languages)) for r in rows])
        _, grads = net.gradients(segments[take].T, (place < lengths[take]).astype(np.float32), labels[take])
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (n, SEGMENT) of all rows' whole bytes, each one's length, and its row; the rest of a last one is 0."""
    size = np.diff(offsets)
    number = -(-size // SEGMENT)
    of = np.repeat(np.arange(len(size)), number)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    start = offsets[of] + inner * SEGMENT
    lengths = np.minimum(SEGMENT, offsets[of + 1] - start)
    at = start[:, None] + np.arange(SEGMENT)
    out = np.where(np.arange(SEGMENT) < lengths[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8)
    return out, lengths, of


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of the label probabilities of every position of each row (rows, languages); zeros for an empty row."""
    segments, lengths, of = cut(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.bias)))
    place = np.arange(SEGMENT)[:, None]
    for a in range(0, len(segments), BLOCK):
        part, n = segments[a : a + BLOCK], lengths[a : a + BLOCK]
        p = net.probabilities(net.read(np.ascontiguousarray(part.T))[0])
        if (n < SEGMENT).any():
            p *= (place < n)[:, :, None]
        np.add.at(total, of[a : a + BLOCK], p.sum(axis=0))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trained(documents: DataFrame) -> tuple[Network | None, list[str]]:
    """The network and the languages it knows, from rows with a lang and a letter that are not held out:
    at most DOCUMENTS of each language, those of the least hash of doc_id, and SEGMENTS evenly spread segments of each."""
    known = documents.where("lang is not null").where(~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").count()
    # a first draw in proportion leaves about twice what is wanted of each language, so that the ranks are few
    u = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    drawn = known.join(F.broadcast(counts), "lang").where(u * F.col("count") < 2 * DOCUMENTS + 100)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(u, "doc_id"))
    chosen = drawn.withColumn("rank", rank).where(F.col("rank") <= DOCUMENTS).select("lang", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segments, lengths, of = cut(*utf8(batch["text"]))
            number = np.bincount(of, minlength=batch.num_rows)
            first = np.cumsum(number) - number
            take = np.unique(first[:, None] + (np.arange(SEGMENTS) * number[:, None]) // SEGMENTS)
            lang = batch["lang"].take(pa.array(of[take]))
            yield pa.RecordBatch.from_arrays([lang, pa.array([segments[i, : lengths[i]].tobytes() for i in take], pa.binary())], ["lang", "segment"])

    rows = sorted((r["lang"], bytes(r["segment"])) for r in map_arrow(chosen, pieces, "lang string, segment binary").collect())
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None, []
    data = np.zeros((len(rows), SEGMENT), np.uint8)
    for i, (_, s) in enumerate(rows):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
    labels = np.array([languages.index(lang) for lang, _ in rows])
    return train(data, np.array([len(s) for _, s in rows]), labels, len(languages)), languages


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, by its whole text.

    lang_pred is a language learned from rows that are not held out, or `und` with score 0 where text
    is null or has no letter, or nothing could be learned. score is the mean probability that the
    network gives the language over all bytes. Equal texts have equal results; repeated rows stay; an
    empty table gives no rows; lang, source and doc_id are no inputs of a prediction.
    """
    net, languages = trained(documents)
    held = documents.sparkSession.sparkContext.broadcast((net, languages))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = held.value
        names = np.array([*languages, "und"], object)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            known = np.array(batch["known"].to_pylist(), bool)
            best, score = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            for a, b in row_slices(offsets) if net is not None else ():
                p = pooled(net, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                best[a:b] = np.where(known[a:b], p.argmax(axis=1), len(languages))
                score[a:b] = np.where(known[a:b], p.max(axis=1), 0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.col("text")).alias("text"), known.alias("known"))
    return map_arrow(rows, label, "doc_id long, held_out boolean, lang_pred string, score double")
