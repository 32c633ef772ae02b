"""Progress of a scoring run, counted by the job that writes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Progress:
    """Counts of a scoring table, filled when its first action has ended."""

    observation: Observation

    def counts(self) -> dict[str, int]:
        """rows, samples' rows guarded and judge errors, all that went by."""
        return {k: int(v or 0) for k, v in self.observation.get.items()}


def watch(scores: DataFrame, name: str = "scores") -> tuple[DataFrame, Progress]:
    """The same rows, and a ``Progress`` that counts them on their way: no
    second pass over the scores. ``progress_listener`` shows a stream's."""
    seen = Observation(name)
    status = F.coalesce(F.col("status"), F.lit("ok"))
    out = scores.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(status == "guarded").alias("guarded"),
                         F.count_if(status == "judge_error").alias("judge_errors"))
    return out, Progress(seen)


def progress_listener(report):
    """A listener that calls ``report(name, batch, counts)`` after every
    micro-batch of a stream whose scores carry ``observe`` metrics."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            for name, row in event.progress.observedMetrics.items():
                report(name, event.progress.batchId, row.asDict())

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    return Listener()
