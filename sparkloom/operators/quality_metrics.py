"""Answer quality metrics by name, on words instead of a judging model.

A sample is (id, question, answer, contexts array<string> in order of rank,
ground_truth).  Texts are compared by their longest common subsequence of words.
A metric that has nothing to judge (no answer, no truth) is null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

#: The part of a sentence's words that must stand in a text, in their order, for the text to support it.
SUPPORT = 0.5
#: Weights of statements and of similarity in the correctness of an answer.
STATEMENTS, SIMILARITY = 0.75, 0.25


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def sentences(text: str | None) -> list[list[str]]:
    return [w for part in re.split(r"[.!?\n]+", text or "") if (w := words(part))]


def entities(text: str | None) -> set[str]:
    """Numbers, and capitalised words that don't open a sentence."""
    found = set(re.findall(r"\d+", text or ""))
    for part in re.split(r"[.!?\n]+", text or ""):
        found |= {w for w in re.findall(r"[^\W_]+", part)[1:] if w[0].isupper()}
    return found


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, all columns of ``b`` at once as bits of one number."""
    places: dict[str, int] = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        met = row & places.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def overlap(a: list[str], b: list[str]) -> float:
    """Harmonic mean of both sides' common part."""
    return 2 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


@dataclass(frozen=True)
class Sample:
    question: str | None
    answer: str | None
    contexts: tuple[str | None, ...]
    ground_truth: str | None

    @cached_property
    def context_words(self) -> list[list[str]]:
        return [words(c) for c in self.contexts]

    @cached_property
    def claims(self) -> list[list[str]]:
        return sentences(self.answer)

    @cached_property
    def truths(self) -> list[list[str]]:
        return sentences(self.ground_truth)


def supports(text: list[str], sentence: list[str]) -> bool:
    return common(sentence, text) >= SUPPORT * len(sentence)


def faithfulness(s: Sample) -> float | None:
    """The part of the answer's sentences that some context supports."""
    return sum(any(supports(c, x) for c in s.context_words) for x in s.claims) / len(s.claims) if s.claims else None


def answer_relevancy(s: Sample) -> float | None:
    """How far answer and question share their words, in order."""
    return overlap(words(s.question), words(s.answer)) if s.claims and words(s.question) else None


def context_precision(s: Sample) -> float | None:
    """Mean precision at the ranks of the contexts that support a sentence of the truth: early ones count more."""
    if not s.truths:
        return None
    found, total = 0, 0.0
    for k, c in enumerate(s.context_words, 1):
        if any(supports(c, x) for x in s.truths):
            found += 1
            total += found / k
    return total / found if found else 0.0


def context_recall(s: Sample) -> float | None:
    """The part of the truth's sentences that some context supports."""
    return sum(any(supports(c, x) for c in s.context_words) for x in s.truths) / len(s.truths) if s.truths else None


def context_entity_recall(s: Sample) -> float | None:
    """The part of the truth's names and numbers that stand in the contexts."""
    wanted = entities(s.ground_truth)
    return len(wanted & {w for c in s.contexts for w in re.findall(r"[^\W_]+", c or "")}) / len(wanted) if wanted else None


def answer_similarity(s: Sample) -> float | None:
    return overlap(words(s.answer), words(s.ground_truth)) if s.claims and s.truths else None


def answer_correctness(s: Sample) -> float | None:
    """Statements that answer and truth share against those of one side, and the similarity of both."""
    if not s.claims or not s.truths:
        return None
    truth, answer = words(s.ground_truth), words(s.answer)
    right = sum(supports(truth, x) for x in s.claims)
    missed = sum(not supports(answer, x) for x in s.truths)
    shared = 2 * right / (2 * right + (len(s.claims) - right) + missed) if right else 0.0
    return STATEMENTS * shared + SIMILARITY * overlap(answer, truth)


Metric = Callable[[Sample], float | None]
METRICS: dict[str, Metric] = {
    f.__name__: f for f in (context_precision, context_recall, faithfulness, answer_relevancy, context_entity_recall, answer_similarity, answer_correctness)
}


def register(name: str, metric: Metric) -> None:
    """A metric of one's own, found by name like the others."""
    METRICS[name] = metric


def evaluate(samples: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(id, metric, score) of each sample and metric; unknown names are left out, all known ones by default."""
    chosen = {n: METRICS[n] for n in (names if names is not None else METRICS) if n in METRICS}
    kind = samples.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, *columns = (batch.column(i) for i in range(5))
            scores = []
            for q, a, c, g in zip(*(x.to_pylist() for x in columns), strict=True):
                sample = Sample(q, a, tuple(c or ()), g)
                scores += [metric(sample) for metric in chosen.values()]
            owner = pa.array([r for r in range(batch.num_rows) for _ in chosen], pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(owner), pa.array(list(chosen) * batch.num_rows, pa.string()), pa.array(scores, pa.float64())], names=["id", "metric", "score"])

    return samples.select("id", "question", "answer", "contexts", "ground_truth").mapInArrow(work, f"id {kind}, metric string, score double")
