"""Languages of a text as a mixture, inferred by expectation-maximisation.

Each language has a table of log-likelihoods over hashed byte trigrams. A text is cut into windows of some words; a window
has the likelihood of its trigrams in every language, and a text is a mixture of windows from several languages.
Expectation-maximisation finds the proportions for a given language set. The set grows one language at a time, from the
most likely single language, as long as the log-likelihood gains more than a penalty for the further proportion.

The tables are fitted on a bounded sample of labelled texts: ``sample`` texts a language are expected, chosen by a hash of
the id and not by place, and their trigrams are counted in Spark. A table has ``2**BITS`` cells, so what reaches the driver
and the tasks is bounded by the number of languages.

Defined cases: a null text or one without a letter is ``und`` with score 0, so is every text if nothing could be learned; a
null id is held out of nothing and never learned from; repeated rows get equal results; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import carried, own, restored


BITS = 16
WINDOW = 6
ROUNDS = 12
PENALTY = 4.0
SAMPLE = 4000
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words of letters, as UTF-8."""
    return _NOT_LETTERS.sub(" ", text).lower().encode().split() if text else []


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table cells of the byte trigrams of every word with a space on either side, and where each word's begin."""
    data = np.frombuffer(b"  " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    mixed = (data[:-2] * np.uint32(0x9E3779B1)) ^ (data[1:-1] * np.uint32(0x85EBCA77)) ^ (data[2:] * np.uint32(0xC2B2AE3D))
    mixed = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return mixed, np.concatenate(([0], np.cumsum(sizes)))[:-1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of each language of a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words := words_of(text):
                own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                own += np.bincount(trigrams(words)[0], minlength=1 << BITS)
    for lang, own in counts.items():
        cells = np.flatnonzero(own)
        yield pa.record_batch(
            [pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(own[cells])],
            names=["lang", "cell", "n"],
        )


def fit(
    labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 0
) -> tuple[list[str], np.ndarray]:
    """Languages, in code point order, and their log-likelihood tables, from rows with an id and a language."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(id).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    # A text is drawn if its hash falls into its language's share of the hash space.
    share = F.lit(0.0)
    for name, count in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, sample / count)).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(1_000_003)) < share * 1_000_003)
    counted = drawn.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(
        _count, "lang string, cell int, n long"
    )
    rows = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(rows["lang"]))
    table = np.full((1 << BITS, len(names)), 0.5)
    for k, name in enumerate(names):
        own = rows[rows["lang"] == name]
        table[own["cell"].to_numpy(), k] += own["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def _maximise(scores: np.ndarray, starts: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every text for its allowed languages; rows of ``scores`` are windows."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    windows = np.bincount(of, minlength=len(starts)).astype(float)
    top = np.where(allowed[of], scores, -np.inf).max(axis=1, keepdims=True)
    likelihood = np.where(allowed[of], np.exp(scores - top), 0.0)
    for _ in range(ROUNDS):
        joint = likelihood * share[of]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, starts, axis=0) / windows[:, None]
    mixture = np.log(np.maximum((likelihood * share[of]).sum(axis=1), 1e-300)) + top[:, 0]
    return share, np.add.reduceat(mixture, starts)


def infer(texts: list[str | None], table: np.ndarray, window: int = WINDOW, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text; a row of zeros for a text without a letter."""
    out = np.zeros((len(texts), table.shape[1]))
    scores, counts, who = [], [], []
    for i, text in enumerate(texts):
        if words := words_of(text):
            cells, begins = trigrams(words)
            scores.append(np.add.reduceat(table[cells], begins[::window], axis=0))
            counts.append(len(scores[-1]))
            who.append(i)
    if not who or not table.shape[1]:
        return out
    score = np.concatenate(scores).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    size = np.array(counts)
    # The most likely single language.
    single = np.add.reduceat(score, starts, axis=0)
    allowed = np.zeros(single.shape, bool)
    allowed[np.arange(len(size)), single.argmax(axis=1)] = True
    share, best = allowed.astype(float), single.max(axis=1)
    active = np.arange(len(size))
    cost = penalty * np.log(np.maximum(size, 2))
    for _ in range(table.shape[1] - 1):
        # Rows of the texts whose set may still grow.
        rows = np.concatenate([np.arange(starts[k], starts[k] + size[k]) for k in active])
        of = np.repeat(np.arange(len(active)), size[active])
        begins = np.concatenate(([0], np.cumsum(size[active])))[:-1]
        own = score[rows]
        inside = np.where(allowed[active][of], own, -np.inf).max(axis=1, keepdims=True)
        # The language that the present set explains worst without: most gained where it beats the set's best.
        gain = np.where(allowed[active], -np.inf, np.add.reduceat(np.maximum(own - inside, 0.0), begins, axis=0))
        # No mixture can gain more than that, so texts with less are done.
        hopeful = gain.max(axis=1) > cost[active]
        if not hopeful.any():
            break
        tried = allowed[active].copy()
        tried[np.arange(len(active)), gain.argmax(axis=1)] = True
        pick = hopeful[of]
        kept = np.flatnonzero(hopeful)
        again = np.repeat(np.arange(len(kept)), size[active[kept]])
        begins = np.concatenate(([0], np.cumsum(size[active[kept]])))[:-1]
        new_share, new = _maximise(own[pick], begins, again, tried[kept])
        better = new - best[active[kept]] > cost[active[kept]]
        active = active[kept[better]]
        if not len(active):
            break
        allowed[active], share[active], best[active] = tried[kept[better]], new_share[better], new[better]
    out[who] = share
    return out


def identify(
    docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text", prefix: str = "lang"
) -> DataFrame:
    """``docs`` without the text, with ``<prefix>_pred``, ``score`` (its proportion) and ``<prefix>_mix`` (all proportions
    above zero). Columns of the same names are replaced."""
    kind = f"struct<{prefix}_pred: string, score: double, {prefix}_mix: map<string, double>>"
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(kind)
    def mixture(texts: pd.Series) -> pd.DataFrame:
        shares = infer(texts.tolist(), shared.value)
        best = shares.argmax(axis=1) if len(names) else np.zeros(len(shares), int)
        found = shares.max(axis=1, initial=0.0) > 0
        pred = [names[b] if ok else UNKNOWN for b, ok in zip(best, found)]
        mix = [{names[k]: float(s[k]) for k in np.flatnonzero(s > 0)} for s in shares]
        score = shares.max(axis=1, initial=0.0).clip(0.0, 1.0)
        return pd.DataFrame({f"{prefix}_pred": pred, "score": score, f"{prefix}_mix": mix})

    new = [f"{prefix}_pred", "score", f"{prefix}_mix"]
    rest = [c for c in docs.columns if c not in (text, *new)]
    found = carried(docs).withColumn("found", mixture(own(text)))
    return found.select(*restored(rest), *[F.col("found").getField(c).alias(c) for c in new])
