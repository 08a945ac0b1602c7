"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of the rows its hash and the hashes of its first 4 to 7 bytes select.
Filters of widths 1, 2 and 3 slide over the words; the maximum of each filter over the whole text
feeds a logistic output. Every labelled row that is not held out is learned from, with its whole text:

* The rows are dealt by hash into units of about UNIT_ROWS rows and UNIT_BYTES of text, in a table
  bucketed by unit.
* Features are counted by label over all units; those of fewer than MIN_DF documents are left out, and a
  feature's first coordinate starts at its log odds.
* In each of ROUNDS rounds every unit trains a copy of the model (Adam, small batches of its rows, in
  numpy), and the changes are averaged: a feature's over the units that changed it. Changes are summed as
  integers, so that their order does not matter. Units of a small table make more passes.
* A fifth of the rows, by hash, is not fitted: the threshold is calibrated on all of them per guessed
  language (by function words), so that every language decides at the same score. Their logits are
  counted in steps of 1 / STEPS.

What comes to the driver is bounded by the model: a row a feature, and counts a step of the logit. The
model (under 4 MB) is broadcast. Scoring is one pass over whole texts in Arrow batches.

Only texts enter a score: labels, lang, source and doc_id never do. Rows whose crc32(doc_id) mod 4 is
2 are held out: their labels are never read. Defined results: a null or empty text is scored as one
empty word; repeated rows get one score each; without usable labels of both kinds every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textops as T
from quire.llm.frames import pick
from quire.llm.shipping import ship
from quire.session import MAX_BUCKETS, materialize

UNIT_ROWS, UNIT_BYTES = 2500, 16 << 20
THRESHOLD = 0.3
HEADS = (4, 5, 6, 7)
BITS = 16
DIM, FILTERS, WIDTHS = 8, 12, (1, 2, 3)
MIN_DF = 3
ROUNDS, SMALL_PASSES = 3, 3
BATCH, RATE, DECAY = 64, 0.02, 1e-4
STEPS, FIXED = 256, float(1 << 24)
BLOCK = 1 << 16
#: frequent function words by which a text's language is guessed
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as on this are",
    "de": "der die und das von zu mit den ist nicht ein für sich auf",
    "fr": "le la les et des un une pour dans que est qui par sur",
    "es": "el los las y en un una por con para es del que se",
}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`features` of many texts, some at a time: hashes are four times the size of the ids."""
    parts = []
    at, size = 0, 0
    for k in range(len(texts) + 1):
        if k == len(texts) or size > 1 << 18:
            x, f, lang = features(pa.array(texts[at:k], pa.string()))
            parts.append((x.astype(np.uint16), f, lang))  # BITS bits
            at, size = k, 0
        if k < len(texts):
            size += len(texts[k])
    count = np.concatenate([np.diff(f) for _, f, _ in parts])
    return np.concatenate([x for x, _, _ in parts]), np.concatenate([[0], np.cumsum(count)]), np.concatenate([x for _, _, x in parts])


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature ids per word, first word per text, guessed language per text). Id 0 is no feature."""
    buf, off = T.flat(pc.utf8_lower(texts))
    _, _, h, first = T.words(buf, off, T.ALNUM, heads=HEADS)
    ids = np.empty(h.shape, np.int32)
    for k in range(h.shape[1]):
        ids[:, k] = (h[:, k] >> np.uint64(64 - BITS)).astype(np.int32) | 1  # odd: never 0
    keys, owner = function_words()
    at = np.searchsorted(keys, h[:, 0])
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == h[:, 0])
    doc = np.searchsorted(first, hit, "right") - 1
    n_lang = len(FUNCTION_WORDS)
    votes = np.bincount(doc * n_lang + owner[at[hit]], minlength=(len(off) - 1) * n_lang).reshape(-1, n_lang)
    return ids, first, votes.argmax(1)


def function_words() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and the language each speaks for (one that several share
    speaks for the first)."""
    own: dict[int, int] = {}
    for k, line in enumerate(FUNCTION_WORDS.values()):
        buf, off = T.flat(pa.array([line]))
        for x in T.words(buf, off, T.ALNUM, heads=HEADS)[2][:, 0].tolist():
            own.setdefault(x, k)
    keys = np.array(sorted(own), np.uint64)
    return keys, np.array([own[int(x)] for x in keys])


def pooled(model: dict, ids: np.ndarray, first: np.ndarray, where: bool = False):
    """Per text and filter the maximum over the text's word positions; with ``where`` also the word
    position of each maximum. A text without words counts as one word without features."""
    E, widest, n_doc = model["E"], max(WIDTHS), len(first) - 1
    n = int(first[-1])
    out = np.full((n_doc, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    arg = np.full(out.shape, -1, np.int64) if where else None
    doc_of = np.repeat(np.arange(n_doc), np.diff(first))
    for a in range(0, n, BLOCK):  # blocks overlap by the widest filter less one
        b, c = min(n, a + BLOCK), min(n, a + BLOCK + widest - 1)
        X = E[ids[a:c, 0]]
        for k in range(1, ids.shape[1]):
            X = X + E[ids[a:c, k]]
        X = np.concatenate([X, np.zeros((widest, DIM), np.float32)])
        doc = np.concatenate([doc_of[a:c], np.full(widest, -1)])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(doc[:b - a])) + 1])
        for w_i, w in enumerate(WIDTHS):
            C = X[:b - a] @ model["W"][w_i][0]
            for k in range(1, w):  # words of the next text don't count
                C += np.where((doc[k:k + b - a] == doc[:b - a])[:, None], X[k:k + b - a], 0) @ model["W"][w_i][k]
            best = np.maximum.reduceat(C, cut, axis=0)
            cols = slice(w_i * FILTERS, (w_i + 1) * FILTERS)
            d = doc[cut]
            if where:
                ends = np.append(cut[1:], b - a)
                for j, (x, y) in enumerate(zip(cut, ends)):
                    at = C[x:y].argmax(0)
                    better = best[j] > out[d[j], cols]
                    arg[d[j], cols] = np.where(better, a + x + at, arg[d[j], cols])
            out[d, cols] = np.maximum(out[d, cols], best)
    out[np.isneginf(out)] = 0.0
    return (out, arg) if where else out


def logits(model: dict, pool: np.ndarray) -> np.ndarray:
    return np.maximum(pool + model["b"], 0) @ model["v"] + model["c"]


def scores(model: dict, z: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Scores in 0..1; the calibrated threshold of every language is THRESHOLD."""
    x = np.clip(z - model["cut"][lang], -30, 30)
    return 1 / (1 + np.exp(-x) * (1 - THRESHOLD) / THRESHOLD)


def start(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, seed: int = 7) -> dict:
    """The model before training, from the features' document counts by label."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    odds = np.log((pos + 0.5) / max(1, n_pos)) - np.log((neg + 0.5) / max(1, n_neg))
    known = pos + neg >= MIN_DF
    E = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    E[:, 0] = odds * (pos + neg) / (pos + neg + 5) / (1 + len(HEADS)) * 2
    E[~known] = 0
    W = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in W:
        w[0, 0, ::2] += 0.5
    return {"E": E, "W": W, "b": np.zeros(len(WIDTHS) * FILTERS, np.float32),
            "v": np.where(np.arange(len(WIDTHS) * FILTERS) % 2 == 0, 0.2, -0.05).astype(np.float32), "c": np.float32(-1),
            "cut": np.zeros(len(FUNCTION_WORDS), np.float32), "known": known}


def train(model: dict, ids: np.ndarray, first: np.ndarray, y: np.ndarray, n_pos: int, n_neg: int, passes: int = 1, seed: int = 7) -> dict:
    """A copy of ``model`` after ``passes`` over these texts. ``n_pos`` and ``n_neg`` are of all units: both labels weigh
    alike."""
    rng = np.random.default_rng(seed)
    m = {**model, "E": model["E"].copy(), "W": [w.copy() for w in model["W"]], "b": model["b"].copy(), "v": model["v"].copy()}
    known = model["known"]
    state: dict[str, list] = {}

    def step(name, p, g, t, rows=None):
        s = state.setdefault(name, [np.zeros_like(p), np.zeros_like(p)])
        i = slice(None) if rows is None else rows
        s[0][i] = 0.9 * s[0][i] + 0.1 * g
        s[1][i] = 0.99 * s[1][i] + 0.01 * g * g
        p[i] -= RATE * ((s[0][i] / (1 - 0.9 ** t)) / (np.sqrt(s[1][i] / (1 - 0.99 ** t)) + 1e-6) + DECAY * p[i])

    order = np.arange(len(y))
    half = {1.0: 0.5 / max(1, n_pos), 0.0: 0.5 / max(1, n_neg)}  # both labels weigh alike in training
    t = 0
    c = np.array([model["c"]], np.float32)
    for _ in range(passes):
        rng.shuffle(order)
        for a in range(0, len(order), BATCH):
            t += 1
            part = np.sort(order[a:a + BATCH])
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            sub = np.concatenate([[0], np.cumsum(first[part + 1] - first[part])])
            mine = ids[rows]
            pool, at = pooled(m, mine, sub, where=True)
            m["c"] = c[0]
            act = np.maximum(pool + m["b"], 0)
            p = 1 / (1 + np.exp(-np.clip(act @ m["v"] + c[0], -30, 30)))
            g = (p - y[part]) * np.array([half[float(q)] for q in y[part]], np.float32) * (n_pos + n_neg) / len(part)
            g_pool = (g[:, None] * m["v"]) * (pool + m["b"] > 0)
            step("v", m["v"], act.T @ g, t)
            step("c", c, np.array([g.sum()], np.float32), t)
            step("b", m["b"], g_pool.sum(0), t)
            g_E: dict[int, np.ndarray] = {}
            touched, grads = [], []
            for w_i, w in enumerate(WIDTHS):
                cols = np.arange(w_i * FILTERS, (w_i + 1) * FILTERS)
                pos_at, gp = at[:, cols], g_pool[:, cols]
                last = np.repeat(sub[1:, None], FILTERS, 1)
                g_W = np.zeros_like(m["W"][w_i])
                for k in range(w):
                    ok = (pos_at >= 0) & (pos_at + k < last)
                    r, q = np.nonzero(ok)
                    words = mine[pos_at[r, q] + k]
                    x = m["E"][words].sum(1)
                    np.add.at(g_W[k].T, q, x * gp[r, q][:, None])
                    gx = gp[r, q][:, None] * m["W"][w_i][k].T[q]
                    touched.append(words.ravel())
                    grads.append(np.repeat(gx, words.shape[1], 0))
                step(f"W{w_i}", m["W"][w_i], g_W, t)
            touched, grads = np.concatenate(touched), np.concatenate(grads)
            ok = known[touched]
            touched, grads = touched[ok], grads[ok]
            if len(touched):
                u, inv = np.unique(touched, return_inverse=True)
                g_rows = np.zeros((len(u), DIM), np.float32)
                np.add.at(g_rows, inv, grads)
                step("E", m["E"], g_rows, t, u)
    m["c"] = c[0]
    return m


def dense(m: dict) -> np.ndarray:
    """All parameters but the embeddings, in rows of DIM."""
    x = np.concatenate([*[w.ravel() for w in m["W"]], m["b"], m["v"], [m["c"]]]).astype(np.float64)
    return np.concatenate([x, np.zeros(-len(x) % DIM)]).reshape(-1, DIM)


def moved(m: dict, change: dict[int, np.ndarray]) -> dict:
    """``m`` with ``change`` added: rows of the embeddings, then those of :func:`dense`."""
    size = 1 << BITS
    E, flat = m["E"].copy(), dense(m)
    for i, x in change.items():
        if i < size:
            E[i] = E[i] + x
        else:
            flat[i - size] += x
    flat, W, at = flat.ravel().astype(np.float32), [], 0
    for w in m["W"]:
        W.append(flat[at:at + w.size].reshape(w.shape))
        at += w.size
    n = len(m["b"])
    return {**m, "E": E, "W": W, "b": flat[at:at + n], "v": flat[at + n:at + 2 * n], "c": flat[at + 2 * n]}


def best_cut(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The logit threshold with the best F1, midway between its neighbours, of ``pos`` and ``neg`` rows at each of ``z``."""
    order = np.argsort(-z)
    tp, fp = np.cumsum(pos[order]), np.cumsum(neg[order])
    f1 = 2 * tp / (tp + fp + pos.sum())
    k = int(f1.argmax())
    zs = z[order]
    return float((zs[k] + zs[k + 1]) / 2) if k + 1 < len(zs) else float(zs[k] - 1)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Every labelled row that is not held out: (unit, h, text, toxic, kept), stored by unit, and the number of units.
    ``kept`` rows are for the thresholds."""
    d = pick(docs, "doc_id", "text").where(~held_out(F.col("doc_id"))).withColumn("text", F.coalesce("text", F.lit("")))
    lab = pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    n, size = d.select("doc_id", F.octet_length("text").alias("size")).join(lab, "doc_id").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows = d.join(lab.hint("merge"), "doc_id")  # the same plan at every size
    units = max(1, -(-n // UNIT_ROWS), -(-size // UNIT_BYTES))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(units)).cast("int").alias("unit"), F.xxhash64("doc_id").alias("h"), "text",
                       F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 4).alias("kept"))
    return materialize(rows, "toxicity_rows", ["unit"], min(units, MAX_BUCKETS)), units


def _counts(batches):
    """(unit, h, text, toxic) to (id, pos, neg): in how many texts of each label a feature occurs."""
    pos, neg = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        ids, first, _ = sample_features(batch.column(0).to_pylist())
        for i, y in enumerate(batch.column(1).to_pylist()):
            (pos if y else neg)[np.unique(ids[first[i]:first[i + 1]])] += 1
    at = np.flatnonzero(pos + neg)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos[at]), pa.array(neg[at])], names=["id", "pos", "neg"])


def _unit_trainer(model_of, n_pos: int, n_neg: int, passes: int):
    def run(rows: pa.Table) -> pa.Table:
        T.release_once()
        rows = rows.sort_by([("h", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        unit, old = rows.column("unit")[0].as_py(), model_of()
        ids, first, _ = sample_features(rows.column("text").to_pylist())
        new = train(old, ids, first, rows.column("toxic").to_numpy().astype(np.float32), n_pos, n_neg, passes, seed=unit)
        at = np.flatnonzero((new["E"] != old["E"]).any(1))
        flat = dense(new) - dense(old)
        change = np.concatenate([new["E"][at].astype(np.float64) - old["E"][at], flat])
        id_ = np.concatenate([at, (1 << BITS) + np.arange(len(flat))]).astype(np.int32)
        fixed = np.rint(change * FIXED).astype(np.int64)
        return pa.Table.from_arrays([pa.array(id_)] + [pa.array(np.ascontiguousarray(fixed[:, k])) for k in range(DIM)],
                                    names=["id"] + [f"d{k}" for k in range(DIM)])
    return run


def _logit_steps(model_of):
    """(text, toxic) to (lang, step, toxic) with the logit in steps."""
    def run(batches):
        model = model_of()
        for batch in batches:
            texts = batch.column(0)
            _, off = T.flat(texts)
            for a, b in T.chunks(off, 1 << 21):
                ids, first, lang = features(texts.slice(a, b - a))
                z = np.clip(np.rint(logits(model, pooled(model, ids, first)) * STEPS), -30 * STEPS, 30 * STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(z.astype(np.int32)), batch.column(1).slice(a, b - a)],
                                                 names=["lang", "step", "toxic"])
    return T.lean(run)


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Train on every labelled row that is not held out."""
    rows, units = training_rows(docs, labels)
    sc = rows.sparkSession.sparkContext
    n = {(r[0], r[1]): r[2] for r in rows.groupBy("kept", "toxic").count().collect()}  # four rows at most
    total = {y: n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)}
    if not (total[0] and total[1]):
        return None
    part, check = rows, rows
    n_neg, n_pos = total[0], total[1]
    if n.get((False, 0)) and n.get((False, 1)):
        part = rows.where("NOT kept")
        n_neg, n_pos = n[False, 0], n[False, 1]
        if n.get((True, 0)) and n.get((True, 1)):
            check = rows.where("kept")
    pos, neg = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    counts = part.select("text", "toxic").mapInArrow(T.lean(_counts), "id int, pos bigint, neg bigint")
    for r in counts.groupBy("id").agg(F.sum("pos"), F.sum("neg")).collect():  # one row a feature
        pos[r[0]], neg[r[0]] = r[1], r[2]
    model = start(pos, neg, n_pos, n_neg)
    names = [f"d{k}" for k in range(DIM)]
    for _ in range(ROUNDS):
        held = sc.broadcast(model)
        changes = part.select("unit", "h", "text", "toxic").groupBy("unit").applyInArrow(
            _unit_trainer(lambda held=held: held.value, n_pos, n_neg, SMALL_PASSES if units == 1 else 1),
            "id int, " + ", ".join(f"{k} bigint" for k in names))
        sums = changes.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names])
        model = moved(model, {r["id"]: np.array([r[k] for k in names]) / (r["n"] * FIXED) for r in sums.collect()})  # one row a parameter row
        held.unpersist()
    held = sc.broadcast(model)
    steps = (check.select("text", "toxic").mapInArrow(_logit_steps(lambda: held.value), "lang int, step int, toxic int")
                  .groupBy("lang", "step").agg(F.sum("toxic"), F.count("*")).collect())  # at most 60 * STEPS + 1 rows a language
    lang, z, p, m = (np.array(x, np.float64) for x in zip(*steps))
    z, q = z / STEPS, m - p

    def cut(own):
        u, at = np.unique(z[own], return_inverse=True)
        return best_cut(u, np.bincount(at, p[own]), np.bincount(at, q[own]))

    overall = cut(np.ones(len(z), bool))
    for k in range(len(FUNCTION_WORDS)):
        own = lang == k
        model["cut"][k] = overall if min(p[own].sum(), q[own].sum()) < 10 else cut(own)
    del model["known"]
    return model


def _score(model_of, at: int):
    def run(batches):
        model = model_of()
        for batch in batches:
            texts = batch.column(at)
            if texts.null_count:
                texts = texts.fill_null("")
            _, off = T.flat(texts)
            out = []
            for a, b in T.chunks(off, 1 << 21):
                if model is None:
                    out.append(np.zeros(b - a))
                    continue
                ids, first, lang = features(texts.slice(a, b - a))
                out.append(scores(model, logits(model, pooled(model, ids, first)), lang))
            cols = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())],
                                             names=[f"c{i}" for i in range(len(cols))] + ["score"])
    return T.lean(run)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """The columns of ``docs`` by position as c0, c1, .. and a score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"
    return base.mapInArrow(_score(lambda: held.value, docs.columns.index("text")), schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    d = pick(docs, "doc_id", "text")
    out = score(d, fit(d, labels))
    return out.select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    names = docs.columns
    out = score(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD)
    return out.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


ship(__name__)
