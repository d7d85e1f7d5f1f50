"""From an export to labelled customers and reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning, clustering, features, mapping, personas, questions, revenue
from ..sources.files import export_csv


@dataclass
class Pipeline:
    """Tables are built on first use and kept; a new mapping or upload forgets what follows from the old one."""

    spark: SparkSession
    mapper: mapping.Mapper = mapping.propose
    labeller: object = personas.label_by_rules
    translator: questions.Translator = questions.translate
    kept: dict = field(default_factory=dict)
    cleaned: cleaning.Cleaned | None = None

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        self.kept[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[name]

    def forget(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
        if self.cleaned:
            self.cleaned.release()
            self.cleaned = None

    def load(self, path: str, overrides: dict[str, str] | None = None) -> mapping.MappingReport:
        self.forget()
        raw, proposals, _ = mapping.run_mapping(self.spark, path, self.mapper)
        self.raw, report = mapping.finalize_mapping(raw, proposals, overrides)
        return report

    def clean(self, reference: dt.datetime | None = None) -> dict:
        self.cleaned = cleaning.clean(self.raw, reference)
        self.lines, self.report = self._keep("lines", self.cleaned.lines), self.cleaned.report_dict()
        self.warnings = cleaning.warnings(self.report)
        if not self.report["rows_out"]:
            raise ValueError("no rows are left after cleaning")
        return self.report

    def segment(self, k: int | None = None, save_to: str | None = None, **sweep) -> DataFrame:
        self.features = self._keep("features", features.engineer_features(self.lines))
        self.clustered = clustering.run_clustering(self.features, k, save_to=save_to, **sweep)
        customers = self._keep("clustered", self.clustered.customers)
        labelled, self.segments = personas.label_customers(customers, self.labeller)
        self.labelled = self._keep("labelled", labelled)
        return self.labelled

    def revenue(self) -> dict[str, DataFrame]:
        shares = revenue.concentration(self.labelled)
        return {"concentration": shares, "totals": revenue.concentration_totals(self.labelled), "long": revenue.long_form(shares), "display": revenue.display_table(shares), "at_risk": revenue.clv_at_risk(self.labelled), "at_risk_segments": revenue.clv_breakdown(self.labelled)}

    def ask(self, question: str) -> dict:
        return questions.answer(question, self.labelled, self.translator)

    def export(self, path: str) -> None:
        export_csv(self.labelled, path)

    def run(self, path: str, overrides: dict[str, str] | None = None, k: int | None = None, reference: dt.datetime | None = None, **sweep) -> DataFrame:
        report = self.load(path, overrides)
        if report.status == "rejected":
            raise ValueError(" ".join(report.messages))
        self.clean(reference)
        return self.segment(k, **sweep)
