"""Live policy: rules that change while a stream of requests is decided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quayside.operators.policy import winning_rules

Rules = list[tuple[int, str]]


class Reload:
    """The rules in force. poll() reads their source again: text that is unchanged, can't be read or isn't a policy leaves
    them as they are, and text that was refused once isn't parsed again."""

    def __init__(self, read: Callable[[], str], parse: Callable[[str], Rules]):
        self.read, self.parse = read, parse
        self.text = read()
        self.rules = parse(self.text)
        self.refused: str | None = None

    def poll(self) -> Rules:
        try:
            text = self.read()
        except Exception as e:  # a store's own errors; the next poll tries again
            self.refused = str(e)
            return self.rules
        if text != self.text:
            self.text = text
            try:
                self.rules, self.refused = self.parse(text), None
            except ValueError as e:
                self.refused = str(e)
        return self.rules


def decided(requests: DataFrame, policy: Reload, write: Callable[[DataFrame, int], None], interval: str = "2 seconds") -> DataStreamWriter:
    """requests: repo, as a stream. write(rows, batch) gets each batch with the rule that wins under the policy in force when
    the batch begins; batches begin at multiples of interval, and one that is late begins at once."""
    return requests.writeStream.trigger(processingTime=interval).foreachBatch(lambda rows, batch: write(winning_rules(rows, policy.poll()), batch))
