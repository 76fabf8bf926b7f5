"""One run over one or many logs: index, watermark, judge, tally, panes, audit."""

from __future__ import annotations

from copy import copy
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame

from paneledger.config import Config
from paneledger.names import END_OF_STREAM
from paneledger.operators import audit, judge, panes, truth
from paneledger.operators.arrival import ArrivalIndex, index_log
from paneledger.operators.crossing import FIRE, RELEASE, crossings
from paneledger.operators.watermarks import attach_watermark
from paneledger.workspace import remember


@dataclass(frozen=True)
class Run:
    """The tables of a run. Each is a lazy DataFrame, built on first use; the
    per-window and per-log ones that most others start from stay in memory until
    ``workspace.release``.

    ``blocks`` and ``block_size`` fix how a log is cut (number of blocks, and rows
    per block); results do not depend on them.
    """

    index: ArrivalIndex
    config: Config
    blocks: int | None = None
    block_size: int | None = None

    @cached_property
    def judged(self) -> DataFrame:
        """Every event with its watermark, window, lateness and class."""
        return judge.judge(attach_watermark(self.index.rows, self.config.watermark, self.index.total, self.block_size), self.config)

    @cached_property
    def tally(self) -> DataFrame:
        return remember(judge.tally(self.judged))

    @cached_property
    def health(self) -> DataFrame:
        return judge.log_health(self.tally)

    @cached_property
    def finals(self) -> DataFrame:
        """Per log: the watermark the run ended with."""
        flushed = self.config.termination == "flush"
        final = f"{END_OF_STREAM}L" if flushed else "w_last"
        return self.health.selectExpr("log_id", "events", f"{final} AS final_watermark")

    @cached_property
    def known(self) -> DataFrame:
        """The tally, and how far each window's log got."""
        return remember(panes.with_ends(self.tally, self.health))

    @cached_property
    def counted(self) -> DataFrame:
        """Every window with any event, and what the run made of it."""
        return panes.window_counts(self.known, self.config)

    @cached_property
    def counts(self) -> DataFrame:
        """The windows that the run kept state for."""
        return self.counted.where("kept")

    @cached_property
    def fired(self) -> DataFrame:
        """Per window, the event that closed it."""
        return crossings(self.judged, self.counts, self.config, [FIRE])

    @cached_property
    def known_crossed(self) -> DataFrame:
        """The windows that the run kept state for, as known, and the events that closed
        and released them."""
        kept = self.known.where(panes.HAS_STATE)
        found = crossings(self.judged, kept, self.config, [FIRE, RELEASE])
        return remember(kept.join(found, audit.KEYS, "left"))

    @cached_property
    def crossed(self) -> DataFrame:
        """Per window, the events that closed and released it."""
        return self.known_crossed.select(*audit.KEYS, FIRE, RELEASE)

    @cached_property
    def counts_crossed(self) -> DataFrame:
        return panes.window_counts(self.known_crossed, self.config)

    @cached_property
    def windows(self) -> DataFrame:
        return panes.window_state(self.counts_crossed, self.config)

    @cached_property
    def firing_panes(self) -> DataFrame:
        return panes.firing_panes(self.counts.join(self.fired, audit.KEYS, "left"), self.config)

    @cached_property
    def panes(self) -> DataFrame:
        return self._with_late_panes(self.firing_panes)

    def _with_late_panes(self, closing: DataFrame) -> DataFrame:
        out = closing.select(*panes.PANE_COLUMNS)
        return out.unionByName(self.late_panes) if self.config.late_policy == "update" else out

    @cached_property
    def late_panes(self) -> DataFrame:
        return panes.late_panes(self.judged, self.known.where(panes.HAS_STATE)).select(*panes.PANE_COLUMNS)

    def ended(self, termination: str) -> Run:
        """The same run under another termination. What that does not change, from the
        judged events to the crossings of each window, is shared with this one."""
        other = copy(self)
        for name in [name for name in vars(other) if isinstance(getattr(type(self), name, None), cached_property)]:
            del vars(other)[name]
        shared = ("judged", "tally", "health", "known", "known_crossed", "late_panes")
        vars(other).update({name: getattr(self, name) for name in shared}, config=replace(self.config, termination=termination))
        return other

    @cached_property
    def side_output(self) -> DataFrame:
        return judge.receipts(self.judged, self.config)

    @cached_property
    def trace(self) -> DataFrame:
        steps = judge.trace(self.judged)
        if self.config.termination == "flush":
            steps = steps.unionByName(self.finals.selectExpr("log_id", "events AS index", "final_watermark AS watermark"))
        return steps

    @cached_property
    def counters(self) -> DataFrame:
        policy = self.config.late_policy
        late = {p: "sum(late_in_bound)" if p == policy else "0L" for p in ("drop", "update")}
        opened = f"count_if({panes.OPENED_LATE})" if policy == "update" else "0L"
        return self.tally.groupBy("log_id").agg(*judge.aggregates(
            total="sum(events)", on_time="sum(on_time)", late_in_bound="sum(late_in_bound)", too_late="sum(too_late)",
            dropped_in_bound=late["drop"],
            discarded_without_receipt="sum(events - on_time - late_in_bound - too_late)",
            revisions_emitted=f"{late['update']} - {opened}", opened_after_close=opened,
        ))

    @cached_property
    def emitted(self) -> DataFrame:
        """The panes with their place ``pos`` in the order of emission."""
        return panes.emission_order(self.panes, self.blocks)

    def write_judged(self, path: str) -> dict[str, int]:
        """Write every judged event, and return the run's counters and the watermark's
        health over all logs, observed by the same job."""
        table, metrics = judge.observed(self.judged)
        table.write.parquet(path)
        return metrics.get

    @cached_property
    def truth(self) -> DataFrame:
        return truth.batch_windows(self.index.events, self.config.window_ms, self.config.offset_ms)

    @cached_property
    def verdict(self) -> DataFrame:
        return audit.verdict_of_run(self.counted, self.config)

    @cached_property
    def findings(self) -> DataFrame:
        """All eight checks."""
        lost = audit.silent_drop_findings(self.verdict)
        return self.run_findings.unionByName(lost).unionByName(audit.window_findings(self.verdict))

    @cached_property
    def health_findings(self) -> DataFrame:
        return audit.overshoot_findings(self.health).unionByName(audit.regression_findings(self.health, self.config))

    @cached_property
    def run_findings(self) -> DataFrame:
        """The checks that the verdict does not imply: watermark, releases, panes."""
        closing = panes.firing_panes(self.counts_crossed, self.config)
        return reduce(DataFrame.unionByName, [
            self.health_findings,
            audit.premature_close_findings(self.windows, self.config),
            audit.pane_count_findings(self.counts, self.config),
            audit.pane_chain_findings(self._with_late_panes(closing)),
        ])

    @cached_property
    def outcome_counts(self) -> DataFrame:
        """Per log: outcomes, and the findings of all eight checks."""
        return audit.verdict_summary(self.verdict, self.run_findings)

    @cached_property
    def summary(self) -> DataFrame:
        """Per log: outcomes, and the findings that the verdict, the watermark and the
        window counts show, from the tally alone. The checks that read every pane and
        every release again are in ``findings`` and ``outcome_counts``."""
        shown = self.health_findings.unionByName(audit.pane_count_findings(self.counts, self.config))
        return audit.verdict_summary(self.verdict, shown).drop("all_receipted")

    @cached_property
    def reasons(self) -> DataFrame:
        return audit.reason_counts(self.verdict)

    @cached_property
    def lateness(self) -> DataFrame:
        return truth.lateness_profile(self.index.rows, self.blocks)


def run_log(log: DataFrame, config: Config, order: list[str] = ["seq"], keep_columns: list[str] = []) -> Run:  # noqa: B006
    """Run ``config`` over a log of ``(log_id, t, *order)``."""
    return Run(index_log(log, order, keep_columns), config)
