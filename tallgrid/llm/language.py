"""Language ID by inference of mixtures.

A language is a distribution over hashed byte trigrams of lower-cased text in which everything but letters counts as a blank.
Training adds up the trigrams of all rows that may teach, in tasks first. A text is seen as a mixture: expectation-maximisation
estimates each language's share from the likelihoods of its trigrams. Its language set is then chosen by penalised likelihood:
languages enter in order of their shares as long as each raises the log-likelihood by more than ``PENALTY`` plus half the
logarithm of the number of trigrams. The prediction is the language with the largest share in the chosen set, its score that
share. What goes to the tasks is the model, ``SLOTS`` numbers a language; scoring shuffles nothing.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, and if nothing was learned; ties go to the
language that comes first by name; repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from tallgrid.llm import rolling
from tallgrid.llm.shared import in_training, prepare

SLOTS, ROUNDS, PENALTY = 1 << 14, 8, 12.0
UNKNOWN = "und"
_FOLD = rolling.LOWER.copy()
_FOLD[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every trigram; a document is read with a blank before and after it."""
    n = len(bounds) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint32)
    document = np.repeat(np.arange(n), np.diff(bounds))
    padded[np.arange(len(data)) + document + 1] = _FOLD[data]
    code = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    owner = np.repeat(np.arange(n), np.diff(bounds) + 1)[:len(code)]
    inside = np.arange(len(code)) + 2 <= (bounds[1:] + np.arange(1, n + 1))[owner]
    blank = (padded[:-2] == 32) & (padded[1:-1] == 32)  # runs of blanks say nothing
    use = inside & ~blank
    slots = code[use] * np.uint32(0x9E3779B1) >> np.uint32(32 - 14)
    return owner[use], slots.astype(np.int64)


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          lang_column: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and the log-probability of every slot in each."""
    rows = docs.where(in_training(id_column)).where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(
        F.col(text_column).cast("string").alias("_text"), F.col(lang_column).cast("string").alias("_lang"))

    def apply(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("_lang").to_pylist(), object)
            for row, data, bounds in rolling.slices(batch.column("_text")):
                document, slots = trigrams(data, bounds)
                known, which = np.unique(names[row:row + len(bounds) - 1], return_inverse=True)
                counts = np.bincount(which[document] * SLOTS + slots, minlength=len(known) * SLOTS).reshape(-1, SLOTS)
                for name, own in zip(known, counts):
                    sums[name] = sums[name] + own if name in sums else own
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                                             ["lang", "slot", "n"])

    counted = rows.mapInArrow(apply, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # languages times slots, whatever the number of rows
    names = sorted(table["lang"].unique())
    counts = np.full((len(names), SLOTS), 0.5)
    counts[[names.index(x) for x in table["lang"]], table["slot"]] += table["n"]
    return names, np.log(counts / counts.sum(1, keepdims=True))


def _em(likelihood: np.ndarray, weight: np.ndarray, first: np.ndarray, sizes: np.ndarray, share: np.ndarray,
        rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares per document and its log-likelihood under them, after ``rounds`` steps; zero shares stay zero."""
    total = np.add.reduceat(weight, first)
    owner = np.repeat(np.arange(len(first)), sizes)
    for _ in range(rounds):
        joint = likelihood * share[owner]
        joint *= (weight / np.maximum(joint.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(joint, first) / total[:, None]
    mixed = np.maximum((likelihood * share[owner]).sum(1), 1e-30)
    return share, np.add.reduceat(weight * np.log(mixed), first)


def mixtures(document: np.ndarray, slots: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents that have trigrams, their language shares in the chosen set, size of the set)."""
    keys, weight = np.unique(document * SLOTS + slots, return_counts=True)
    owner = keys // SLOTS
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    if not len(first):
        return owner, np.zeros((0, model.shape[0])), owner
    sizes = np.diff(np.append(first, len(owner)))
    logs = model[:, keys % SLOTS].T
    likelihood = np.exp(logs - logs.max(1, keepdims=True))
    weight = weight.astype(np.float64)
    n, k = len(first), model.shape[0]
    share, _ = _em(likelihood, weight, first, sizes, np.full((n, k), 1.0 / k), ROUNDS)
    rank = np.argsort(-share, axis=1, kind="stable")
    barrier = PENALTY + 0.5 * np.log(np.add.reduceat(weight, first))
    chosen, size = np.zeros((n, k)), np.ones(n, np.int64)
    chosen[np.arange(n), rank[:, 0]] = 1.0
    _, best = _em(likelihood, weight, first, sizes, chosen, 0)
    active = np.arange(n)
    for m in range(2, k + 1):
        if not len(active):
            break
        mask = np.repeat(np.isin(np.arange(n), active), sizes)
        own = np.append(0, np.cumsum(sizes[active]))[:-1]
        start = np.zeros((len(active), k))
        np.put_along_axis(start, rank[active, :m], np.take_along_axis(share[active], rank[active, :m], 1) + 1e-6, 1)
        start /= start.sum(1, keepdims=True)
        grown, value = _em(likelihood[mask], weight[mask], own, sizes[active], start, ROUNDS // 2)
        better = value - best[active] > barrier[active]
        active, grown = active[better], grown[better]
        chosen[active], best[active], size[active] = grown, value[better], m
    return owner[first], chosen, size


def _has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ascii_letter = (_FOLD[data] != 32) & (data < 128)
    counts = np.append(0, np.cumsum(ascii_letter))
    out = counts[bounds[1:]] > counts[bounds[:-1]]
    for i in np.flatnonzero(~out & (bounds[1:] > bounds[:-1])):
        out[i] = any(c.isalpha() for c in data[bounds[i]:bounds[i + 1]].tobytes().decode(errors="replace"))
    return out


def predicted(docs: DataFrame, names: list[str], model: np.ndarray, text_column: str = "text") -> DataFrame:
    """``_row`` (the input row), ``lang_pred``, ``score`` and ``langs``, the chosen set with shares."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast((names, model))
    schema = (rows.select("_row").schema.add("lang_pred", "string").add("score", "double")
              .add("langs", MapType(StringType(), DoubleType())))

    def apply(batches):
        own, logs = sent.value
        for batch in batches:
            best, score, sets = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), [{}] * batch.num_rows
            for row, data, bounds in rolling.slices(batch.column("_text")) if own else ():
                letters = _has_letter(data, bounds)
                found, share, _ = mixtures(*trigrams(data, bounds), logs)
                top = share.argmax(1) if len(found) else found
                for d, k, shares in zip(found.tolist(), top.tolist(), share):
                    if letters[d]:
                        best[row + d], score[row + d] = own[k], min(1.0, shares[k])
                        sets[row + d] = {own[j]: float(shares[j]) for j in np.flatnonzero(shares)}
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(best, pa.string()), pa.array(score),
                 pa.array([list(s.items()) for s in sets], kind)], ["_row", "lang_pred", "score", "langs"])

    return rows.mapInArrow(apply, schema)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    prepare(docs.sparkSession)
    names, model = learn(docs, id_column, text_column, lang_column)
    return predicted(docs, names, model, text_column)
