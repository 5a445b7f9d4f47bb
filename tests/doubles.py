"""Annotators for tests only."""
import os
import uuid

from labelloop.operators.annotate import Retryable, majority_answer_annotator


class FlakyAnnotator:
    """The first ``failures`` calls raise."""

    def __init__(self, inner, failures=1, error=Retryable):
        self.inner, self.failures, self.error, self.calls = inner, failures, error, 0

    def __call__(self, batch):
        self.calls += 1
        if self.calls <= self.failures:
            raise self.error("rate limited")
        return self.inner(batch)


class Counted:
    """Leaves a file for every prompt that was paid for; dies while ``folder``/die has a number
    of calls left to count down, as a killed task would."""

    def __init__(self, folder, dies_after=None):
        self.folder, self.dies_after, self.calls = str(folder), dies_after, 0

    def __call__(self, batch):
        if self.dies_after is not None and self.calls >= self.dies_after and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            raise SystemError("the task is killed")
        self.calls += 1
        for messages in batch:
            with open(f"{self.folder}/paid-{uuid.uuid4().hex}", "w") as f:
                f.write(messages[-2]["content"])
        return majority_answer_annotator(batch)

    @staticmethod
    def paid(folder):
        out = []
        for name in os.listdir(folder):
            if name.startswith("paid-"):
                with open(f"{folder}/{name}") as f:
                    out.append(f.read())
        return sorted(out)
