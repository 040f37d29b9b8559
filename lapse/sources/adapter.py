"""The dataset contract: load native tables, clean them, standardise them, split them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import assemble as A
from lapse.operators import labels as L
from lapse.operators import relative as R
from lapse.operators.assemble import ModelingData
from lapse.schema import available_groups, conform
from lapse.settings import Settings


@dataclass(frozen=True)
class Adapter:
    """Base of every dataset. Subclasses fill the fields and the three steps.

    ``route`` picks the split: user_disjoint, user_relative, native or global. ``options`` carries
    per-dataset switches such as row samples.
    """

    name: str
    ecosystem: str
    window_days: int | None
    groups: tuple[str, ...]
    route: str = "global"
    native_label: bool = False
    citation: str = ""
    source_url: str = ""
    size_hint: str = ""
    justification: str = ""
    options: dict = field(default_factory=dict)
    hard_checks: bool = False

    # -- the three steps ---------------------------------------------------------------------

    def inputs(self, root: str) -> list[tuple[str, list[str]]]:
        """(label, candidate paths) of every expected input."""
        return []

    def load(self, spark: SparkSession, root: str) -> DataFrame:
        raise NotImplementedError

    def clean(self, raw: DataFrame) -> DataFrame:
        return raw

    def standard(self, clean: DataFrame) -> DataFrame:
        return clean

    # -- shared behaviour --------------------------------------------------------------------

    def events(self, spark: SparkSession, root: str) -> DataFrame:
        """Loaded, cleaned and standardised rows."""
        return conform(self.standard(self.clean(self.load(spark, root))))

    def feature_groups(self, events: DataFrame) -> list[str]:
        """Declared groups whose columns the rows really carry."""
        return available_groups(events, self.groups)

    def window(self, settings: Settings) -> int:
        return self.window_days or settings.window_days

    @property
    def label_columns(self) -> tuple[str, ...]:
        """Columns of the source that tell the outcome; none of them may be a feature."""
        return ()

    def native_labels(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} ships no label")

    def predictors(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} ships no native predictors")

    def relative_split(self, events: DataFrame, settings: Settings) -> ModelingData:
        return R.cadence_split(events, self.groups, settings.split_ratio, settings.seed)

    def split(
        self, events: DataFrame, settings: Settings | None = None, window: int | None = None
    ) -> ModelingData:
        """Labelled train and test matrices by this dataset's route."""
        s = settings or Settings()
        days = window or self.window(s)
        if self.route == "user_disjoint":
            return A.disjoint_split(
                events, days, s.train_quantile, self.groups, s.min_train_users, s.min_test_users)
        if self.route == "user_relative":
            return self.relative_split(events, s)
        if self.route == "native":
            return A.native_split(
                self.predictors(events), self.native_labels(events), s.split_ratio, s.seed)
        if self.native_label:
            return A.native_snapshot_split(
                events, self.native_labels(events), s.train_quantile, self.groups)
        return A.global_split(events, days, s.train_quantile, self.groups)

    def validity(self, events: DataFrame, data: ModelingData) -> DataFrame | None:
        """Hard temporal checks for datasets that ask for them."""
        if not self.hard_checks or data.cutoffs is None:
            return None
        labels = data.train.select(L.LABEL).unionByName(data.test.select(L.LABEL))
        return L.temporal_checks(events, data.cutoffs, labels, data.features, self.label_columns)

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One catalogue row."""
        row = (
            self.name, self.ecosystem, self.citation, self.source_url, self.size_hint,
            self.window_days, self.justification, self.native_label, list(self.groups),
        )
        return spark.createDataFrame(
            [row],
            "dataset_name string, ecosystem_type string, citation string, source_url string, "
            "approximate_size string, window_days int, window_justification string, "
            "uses_native_label boolean, available_feature_groups array<string>",
        )


def join_path(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def literal_defaults(**values):
    """Constant columns by name; None becomes a null string."""
    return {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in values.items()}
