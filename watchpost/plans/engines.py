"""Request-level entry points, one object per dataset.

A user of the reference calls per-dataset functions (filter options,
typeahead, metrics, the charts, a filtered page, an export) and, across
datasets, the overview and the snapshot history.  These classes offer the
same calls over a DataFrame (usually the Parquet store from
``sources.store.store``); each call returns a lazy DataFrame (or writes, for
exports), composed from the operators in ``watchpost.operators``.

Given ``summaries=(root, fingerprint)``, the filter-independent calls
(metrics, charts, options) read the results computed once at ingest
(``plans.summaries``) instead of scanning the store again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from watchpost.operators import breakdowns as bd
from watchpost.operators import filters as flt
from watchpost.operators import metrics as met
from watchpost.operators import options as opt
from watchpost.operators import overview as ovw
from watchpost.operators import paging as pg
from watchpost.operators import timeline as tl
from watchpost.plans import summaries as summ
from watchpost.schema import ALERTS, DEPS, SECRETS, TYPEAHEAD_DEFAULT
from watchpost.sources import export


@dataclass
class Page:
    """A filtered page: one row of paging facts and the page rows."""

    envelope: DataFrame
    rows: DataFrame


@dataclass
class _Engine:
    df: DataFrame
    summaries: tuple[str, str] | None = None
    _built: set = field(default_factory=set, repr=False)
    dataset = ""

    def _whole(self, name: str, live) -> DataFrame:
        """A filter-independent result: stored if built at ingest, else live."""
        if self.summaries is not None:
            root, fingerprint = self.summaries
            spark = self.df.sparkSession
            if name not in self._built and summ.present(
                spark, summ.location(root, self.dataset, fingerprint, name)
            ):
                self._built.add(name)
            if name in self._built:
                return summ.read(spark, root, self.dataset, fingerprint, name)
        return live(self.df)

    binding = None

    def page_after(self, last: list | dict | None, page_size: int = 50, repeats: int = 1, **filters) -> DataFrame:
        """Seek paging: the rows after the row whose page-order key is ``last``
        (``None`` for the first page; a dict is a whole row).  Cost does not
        grow with depth.  ``repeats``: rows equal to it already shown."""
        f = flt.apply(self.df, self.binding, **filters)
        if isinstance(last, dict):
            last = [last.get(c) for c in pg.order_names(f, self.binding)]
        return pg.page_after(f, self.binding, last, page_size, repeats)

    def _typeahead(self, summary: str, alias: str, q: str, limit: int) -> DataFrame:
        """Typeahead over the stored distinct values when built, else the store."""
        values = self._whole(summary, summ.SUMMARIES[self.dataset][summary])
        return opt.typeahead(values, alias, q, limit)


@dataclass
class AlertsEngine(_Engine):
    dataset = "alerts"
    binding = ALERTS

    def filter_options(self) -> DataFrame:
        return self._whole("options", opt.alerts)

    def search_orgs(self, q: str = "", limit: int = TYPEAHEAD_DEFAULT) -> DataFrame:
        return self._typeahead("orgs", "org", q, limit)

    def metrics(self) -> DataFrame:
        return self._whole("metrics", met.alerts)

    def agg_severity(self) -> DataFrame:
        return self._whole("severity", bd.alert_severity)

    def agg_state(self) -> DataFrame:
        return self._whole("state", bd.alert_state)

    def agg_ecosystem(self) -> DataFrame:
        return self._whole("ecosystem", bd.alert_ecosystem)

    def agg_org(self) -> DataFrame:
        return self._whole("org", bd.alert_org)

    def agg_trend(self) -> DataFrame:
        return self._whole("trend", bd.alert_trend)

    def page(self, page: int = 1, page_size: int = 50, **filters) -> Page:
        f = flt.alerts(self.df, **filters)
        return Page(pg.envelope(f, page, page_size), pg.page(f, ALERTS, page, page_size))

    def export(self, path: str, **filters) -> str:
        return export.alerts(self.df, path, **filters)


@dataclass
class SecretsEngine(_Engine):
    dataset = "secrets"
    binding = SECRETS

    def filter_options(self) -> DataFrame:
        return self._whole("options", opt.secrets)

    def search_orgs(self, q: str = "", limit: int = TYPEAHEAD_DEFAULT) -> DataFrame:
        return self._typeahead("orgs", "org", q, limit)

    def metrics(self) -> DataFrame:
        return self._whole("metrics", met.secrets)

    def agg_secret_type(self) -> DataFrame:
        return self._whole("secret_type", bd.secret_type)

    def agg_state(self) -> DataFrame:
        return self._whole("state", bd.secret_state)

    def agg_validity(self) -> DataFrame:
        return self._whole("validity", bd.secret_validity)

    def agg_org(self) -> DataFrame:
        return self._whole("org", bd.secret_org)

    def agg_trend(self) -> DataFrame:
        return self._whole("trend", bd.secret_trend)

    def page(self, page: int = 1, page_size: int = 50, **filters) -> Page:
        f = flt.secrets(self.df, **filters)
        return Page(pg.envelope(f, page, page_size), pg.page(f, SECRETS, page, page_size))

    def export(self, path: str, **filters) -> str:
        return export.secrets(self.df, path, **filters)


@dataclass
class DepsEngine(_Engine):
    dataset = "deps"
    binding = DEPS

    def filter_options(self) -> DataFrame:
        return self._whole("options", opt.deps)

    def search_orgs(self, q: str = "", limit: int = TYPEAHEAD_DEFAULT) -> DataFrame:
        return self._typeahead("orgs", "org", q, limit)

    def search_repos(self, q: str = "", limit: int = TYPEAHEAD_DEFAULT) -> DataFrame:
        return self._typeahead("repos", "repo", q, limit)

    def metrics(self) -> DataFrame:
        return self._whole("metrics", met.deps)

    def agg_package_file(self) -> DataFrame:
        return self._whole("package_file", bd.deps_manifest)

    def agg_org(self) -> DataFrame:
        return self._whole("org", bd.deps_org)

    def agg_repo(self) -> DataFrame:
        return self._whole("repo", bd.deps_repo)

    def agg_top_dependencies(self) -> DataFrame:
        return self._whole("top_dependencies", bd.deps_top)

    def agg_open_source(self) -> DataFrame:
        return self._whole("open_source", bd.deps_open_source)

    def page(self, page: int = 1, page_size: int = 50, **filters) -> Page:
        f = flt.deps(self.df, **filters)
        return Page(pg.envelope(f, page, page_size), pg.page(f, DEPS, page, page_size))

    def export(self, path: str, **filters) -> str:
        return export.deps(self.df, path, **filters)


@dataclass
class Overview:
    """Landing page over alerts and/or secrets (either may be missing).

    With ``stored=(root, alerts_fp, secrets_fp)`` the board and totals built
    by ``summaries.build_overview`` for that pair of store versions are read
    instead of recomputed; risk, heat and rank derive from the board."""

    alerts: DataFrame | None
    secrets: DataFrame | None
    stored: tuple[str, str | None, str | None] | None = None

    def _read(self, name: str) -> DataFrame | None:
        if self.stored is None:
            return None
        root, afp, sfp = self.stored
        spark = (self.alerts if self.alerts is not None else self.secrets).sparkSession
        path = f"{summ.overview_location(root, afp, sfp)}/{name}"
        return summ.read_overview(spark, root, afp, sfp, name) if summ.present(spark, path) else None

    def orgs(self) -> DataFrame:
        board = self._read("board")
        return board if board is not None else ovw.orgs(self.alerts, self.secrets)

    def totals(self) -> DataFrame:
        totals = self._read("totals")
        return totals if totals is not None else ovw.totals(self.alerts, self.secrets)

    def risk(self) -> DataFrame:
        return ovw.risk(self.orgs())

    def heat(self) -> DataFrame:
        return ovw.heat(self.orgs())

    def rank(self) -> DataFrame:
        return ovw.rank(self.orgs())


@dataclass
class Timeline:
    """The snapshot history stored at ``path``."""

    spark: SparkSession
    path: str

    def record(self, metrics: DataFrame, source: str, fingerprint: str) -> int:
        return tl.append(self.spark, self.path, tl.from_metrics(metrics, source, fingerprint))

    def get(self, source: str | None = None) -> DataFrame:
        return tl.read(tl.read_history(self.spark, self.path), source)

    def merged(self) -> DataFrame:
        return tl.merge(tl.read_history(self.spark, self.path))
