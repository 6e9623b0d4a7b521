"""The stages wired together; each stage result is a written table the next ones read."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.functions import calendar as cal
from stockweave.functions.metrics import summarize_forecasts, summarize_levels
from stockweave.functions.quantiles import grouped_quantiles
from stockweave.models import ets, features, gbt, iforest, naive
from stockweave.operators import daily as D
from stockweave.operators import gates as G
from stockweave.operators import inventory as I
from stockweave.operators import orders as O
from stockweave.operators import risk as R
from stockweave.operators import validate as V
from stockweave.operators import weekly as W
from stockweave.params import SERIES, Params
from stockweave.plans import backtest as B
from stockweave.plans import forecast as FC
from stockweave.sources import adapter, files, schemas
from stockweave.sources.staging import StageStore

NAIVE_MODELS = ("ma4", "seasonal_naive")
ALL_MODELS = ("ma4", "seasonal_naive", "ets", "gbt")


class Pipeline:
    """Lazy stages over one set of raw relations."""

    def __init__(
        self, spark: SparkSession, sf_dir: str, params: Params | None = None, grain: str = "type_flag",
        models: tuple[str, ...] = ALL_MODELS, store: StageStore | None = None, relations: adapter.RawRelations | None = None,
    ) -> None:
        """``relations`` are the user's own four tables; without them they are derived from the star schema in ``sf_dir``."""
        self.spark, self.sf_dir, self.grain, self.models, self.relations = spark, sf_dir, grain, models, relations
        self.p = params or Params()
        self.store = store or StageStore(spark, grain)
        self.tag = "-".join(models)

    @classmethod
    def of(cls, spark: SparkSession, relations: adapter.RawRelations, params: Params, models: tuple[str, ...] = ALL_MODELS) -> Pipeline:
        """A run on the user's own relations; ``params`` gives its dates."""
        return cls(spark, "", params, grain="own", models=models, relations=relations)

    def validate(self) -> None:
        """Every schema, key, sign and reference check on the raw relations; raises at the first that fails."""
        files.check_sell_out(self.sell_out())
        files.check_stores(self.stores())
        files.check_catalog(self.catalog_raw())
        files.check_inventory(self.inventory())
        V.assert_unique(self.catalog(), ["upc"], "catalog")
        V.require_no_rows(V.unmatched_keys(self.inventory(), self.stores(), "store_nbr"), "inventory: stores missing from the store catalog")
        V.require_no_rows(V.unmatched_keys(self.sell_out(), self.catalog(), "upc"), "sell_out: products missing from the product catalog")
        outside = self.sell_out().filter((F.col("date") < F.lit(self.p.first_week)) | (F.col("date") >= F.date_add(F.lit(self.p.last_week), 7)))
        V.require_no_rows(outside, f"sell_out: dates outside the weeks {self.p.first_week} to {self.p.last_week}")

    def publish(self, folder: str, anomalies: bool = True) -> None:
        """The files for the business: forecasts by origin, alerts, orders, their summary and the scorecard, as CSV with 4 decimals."""
        for label in ("final", "risk_eval"):
            files.write_csv(self.forecast(label), f"{folder}/forecast_{label}", 4)
        files.write_csv(self.alerts(anomalies), f"{folder}/alerts", 4)
        files.write_csv(O.order_file(self.orders()), f"{folder}/orders", 4)
        files.write_csv(self.order_summary(), f"{folder}/order_summary", 4)
        files.write_csv(self.scorecard(anomalies), f"{folder}/scorecard", 4)

    def run(self, anomalies: bool = True, strict: bool = False) -> DataFrame:
        """Every stage up to the scorecard. Stages that do not need each other run as concurrent jobs.

        ``strict`` checks the relations first and raises, once the scorecard is written, if a hard gate fails.
        """
        if strict:
            self.validate()
        with ThreadPoolExecutor(4) as pool:

            def together(*stages: Callable[[], DataFrame]) -> None:
                list(pool.map(lambda stage: stage(), stages))

            together(self.sell_out, self.inventory if self.relations else self.shelf)
            together(self.daily, self.inventory_cedis, self.catalog_raw)
            self.weekly()
            together(self.backtest, self.forecast_raw, self.series)
            together(self.selection, self.holdout, self.blind_regret)
            self.forecast()
            together(lambda: self.method_metrics(anomalies), lambda: self.alerts(anomalies), self.order_summary)
        card = self.scorecard(anomalies)
        if strict:
            G.require_pass(card)
        return card

    # ------------------------------------------------------------------ prepare
    def lines(self) -> DataFrame:
        return adapter.sales_lines(self.spark, self.sf_dir, self.grain)

    def sell_out(self) -> DataFrame:
        if self.relations:
            return self.store.table("sell_out", lambda: V.project(self.relations.sell_out, schemas.SELL_OUT, "sell_out"))
        return self.store.table("sell_out", lambda: adapter.sell_out(self.lines()))

    def shelf(self) -> DataFrame:
        return self.store.table("shelf", lambda: adapter.shelf(self.lines()))

    def stores(self) -> DataFrame:
        if self.relations:
            return self.store.table("stores", lambda: V.project(self.relations.stores, schemas.STORE_CATALOG, "store_catalog"))
        return self.store.table("stores", lambda: adapter.stores(self.shelf()))

    def inventory(self) -> DataFrame:
        if self.relations:
            return self.store.table("inventory", lambda: V.project(self.relations.inventory, schemas.INVENTORY, "inventory"))
        return self.store.table("inventory", lambda: adapter.inventory(self.shelf(), self.sell_out()))

    def catalog_raw(self) -> DataFrame:
        if self.relations:
            return self.store.table("catalog_raw", lambda: V.project(self.relations.catalog, schemas.UPC_CATALOG, "upc_catalog"))
        return self.store.table("catalog_raw", lambda: adapter.catalog(self.sell_out()))

    def catalog(self) -> DataFrame:
        return I.dedupe_catalog(self.catalog_raw())

    def last_sale(self):
        return self.sell_out().agg(F.max("date")).scalar()

    def calendar(self) -> DataFrame:
        end = F.date_add(self.last_sale(), self.p.calendar_tail_days)
        return self.store.table("calendar", lambda: cal.daily_calendar(self.spark, self.p.first_week, end).coalesce(1))

    def weekly_calendar(self) -> DataFrame:
        return cal.weekly_calendar(self.calendar())

    def daily(self) -> DataFrame:
        def build() -> DataFrame:
            grid = D.complete_daily_calendar(self.sell_out(), self.last_sale())
            flagged = D.flag_outliers(grid, self.p.outlier_z, self.p.outlier_window, self.p.outlier_min_obs)
            return D.attach_calendar(flagged, self.calendar())

        return self.store.table("daily", build)

    def stock(self) -> DataFrame:
        return I.load_inventory(self.inventory(), self.stores())

    def inventory_cedis(self) -> DataFrame:
        return self.store.table("inventory_cedis", lambda: I.aggregate_to_cedis(self.stock(), self.p.clip_negative))

    def weekly(self) -> DataFrame:
        return self.store.table("weekly", lambda: W.build_weekly(
            self.daily(), self.weekly_calendar(), self.catalog(), self.p.first_week, self.p.last_week, self.p.min_days_for_week
        ))

    def series(self) -> DataFrame:
        return self.store.table("series", lambda: W.build_series(
            self.daily(), self.weekly(), self.inventory_cedis(), self.catalog(), self.p.as_of, self.p.cold_start_weeks
        ))

    # ------------------------------------------------------------------ models
    def horizon_rows(self) -> DataFrame:
        return features.horizon_rows(self.weekly(), self.weekly_calendar(), self.p.horizon)

    def _model(self, name: str, label: str) -> B.Model:
        h = self.p.horizon
        if name == "ma4":
            return lambda weekly, origins: naive.moving_average(weekly, origins, h)
        if name == "seasonal_naive":
            return lambda weekly, origins: naive.seasonal_naive(weekly, origins, h)
        if name == "ets":
            return lambda weekly, origins: ets.ets_damped(weekly, origins, h)

        def run_gbt(weekly: DataFrame, origins) -> DataFrame:
            found = gbt.gbt_quantiles(self.horizon_rows(), self.weekly(), self._gbt_tasks(), self.store.table, gbt.GbtSettings(seed=self.p.seed))
            return found.filter(F.col("label") == label).drop("label")

        return run_gbt

    def _gbt_tasks(self) -> list[gbt.Task]:
        """The models of the backtest and of the forecast, which one run trains together."""
        past = [gbt.Task("backtest", i, o, self.p.cold_start_weeks) for i, o in enumerate(self.p.fold_origins())]
        return past + [gbt.Task("forecast", i, o, 1) for i, o in enumerate((self.p.last_week, self.p.risk_origin))]

    def _models(self, label: str) -> list[B.Model]:
        return [self._model(m, label) for m in self.models]

    # ------------------------------------------------------------------ backtest
    def backtest(self) -> DataFrame:
        return self.store.table(f"backtest_{self.tag}", lambda: B.run_backtest(
            self.weekly(), self._models("backtest"), self.p.fold_origins(), self.p.cold_start_weeks
        ))

    def metrics(self) -> DataFrame:
        return self.store.table(f"metrics_{self.tag}", lambda: summarize_levels(self.backtest(), B.LEVELS_REPORTED))

    def metrics_of(self, level: str) -> DataFrame:
        return self.metrics().filter(F.col("level") == level).select(
            *B.LEVELS_REPORTED[level], "n", "wape", "mape", "bias", "pinball", "coverage_90", "coverage_80", "width_rel"
        )

    def selection(self) -> DataFrame:
        return self.store.table(f"selection_{self.tag}", lambda: B.select_models(self.metrics_of("fold"), self.p.selection_tolerance))

    def calibration(self) -> DataFrame:
        early = F.col("fold") < self.p.n_calibration_folds
        return self.store.table(f"calibration_{self.tag}", lambda: B.calibrate_intervals(self.backtest().filter(early)))

    def holdout_rows(self) -> DataFrame:
        """The last folds, raw and with the intervals calibrated on the early folds."""
        late = F.col("fold") >= self.p.n_calibration_folds
        return self.store.table(f"holdout_rows_{self.tag}", lambda: B.raw_and_calibrated(self.backtest().filter(late), self.calibration()))

    def holdout(self) -> DataFrame:
        return self.store.table(f"holdout_{self.tag}", lambda: summarize_forecasts(self.holdout_rows(), ["quantiles", "model", "cluster"]))

    def holdout_overall(self) -> DataFrame:
        """The same per model over all clusters; median widths can't be averaged from the cluster rows."""
        return self.store.table(f"holdout_overall_{self.tag}", lambda: summarize_forecasts(self.holdout_rows(), ["quantiles", "model"]))

    # ------------------------------------------------------------------ blind test
    def usable_folds(self) -> DataFrame:
        rows = self.store.table(f"usable_{self.tag}", lambda: B.folds_with_role(self.backtest(), self.p.horizon, "usable"))
        if rows.isEmpty():
            raise ValueError("blind test: no fold ends before the sealed origin")
        return rows

    def blind_calibration(self) -> DataFrame:
        return self.store.table(f"blind_calibration_{self.tag}", lambda: B.calibrate_intervals(self.usable_folds()))

    def sealed_rows(self) -> DataFrame:
        """The sealed fold, raw and with calibration from the usable folds only."""
        return self.store.table(f"sealed_{self.tag}", lambda: B.raw_and_calibrated(
            B.folds_with_role(self.backtest(), self.p.horizon, "sealed"), self.blind_calibration()
        ))

    def blind_metrics(self) -> DataFrame:
        return self.store.table(f"blind_metrics_{self.tag}", lambda: summarize_levels(
            self.sealed_rows(), {"overall": ("quantiles", "model"), "cluster": ("quantiles", "model", "cluster")}
        ))

    def blind_overall(self) -> DataFrame:
        return B.blind_overall(self.blind_metrics().filter("level = 'overall'").drop("level", "cluster"))

    def blind_cluster(self) -> DataFrame:
        return self.blind_metrics().filter("level = 'cluster' and quantiles = 'calibrated'").drop("level", "quantiles")

    def preselection(self) -> DataFrame:
        return self.store.table(f"preselection_{self.tag}", lambda: B.select_models(
            summarize_forecasts(self.usable_folds(), ["model", "cluster", "fold"]), self.p.selection_tolerance
        ))

    def blind_regret(self) -> DataFrame:
        return self.store.table(f"blind_regret_{self.tag}", lambda: B.blind_regret(self.blind_cluster(), self.preselection()))

    # ------------------------------------------------------------------ forecast
    def forecast_raw(self) -> DataFrame:
        origins = {"final": self.p.last_week, "risk_eval": self.p.risk_origin}
        return self.store.table(f"forecast_raw_{self.tag}", lambda: FC.forecast_at_origins(self.weekly(), self._models("forecast"), origins))

    def forecast_all(self) -> DataFrame:
        return self.store.table(f"forecast_all_{self.tag}", lambda: FC.calibrated_forecast(self.forecast_raw(), self.series(), self.calibration()))

    def forecast(self, label: str = "final") -> DataFrame:
        selected = self.store.table(f"forecast_{self.tag}", lambda: FC.apply_selection(
            self.forecast_all(), self.selection(), self.series(), self.p.cold_start_weeks
        ))
        return selected.filter(F.col("origin_label") == label)

    # ------------------------------------------------------------------ risk
    def _with_anomalies(self, scored: DataFrame, name: str) -> DataFrame:
        """Isolation-forest score and alert on the top share, refitted on the given rows."""
        with_score = self.store.table(f"{name}_scores_{self.tag}", lambda: iforest.isolation_scores(
            self.store.table(f"{name}_rules_{self.tag}", lambda: scored), R.ANOMALY_FEATURES, [*SERIES, "date"], self.p.seed
        ))
        cut = grouped_quantiles(with_score, [], {"cut": ("iforest_score", 1 - self.p.contamination)}).scalar()
        return with_score.withColumn("alert_iforest", F.coalesce(F.col("iforest_score") > cut, F.lit(False)))

    def score_window(self) -> DataFrame:
        """Rule scores of the whole inventory window with the forecast known at the risk origin."""
        inv = self.inventory_cedis()
        start, end = inv.agg(F.min("date")).scalar(), inv.agg(F.date_add(F.max("date"), self.p.lookahead_days)).scalar()
        demand = R.daily_forecast(self.forecast("risk_eval"), self.daily(), F.date_add(F.lit(self.p.risk_origin), 6), start, end)
        return R.score_days(inv, demand, self.daily(), self.series(), self.p.prob_threshold, self.p.lookahead_days)

    def labeled(self, anomalies: bool = True) -> DataFrame:
        name = f"labeled_{self.tag}" if anomalies else f"labeled_rules_{self.tag}"

        def build() -> DataFrame:
            scored = self._with_anomalies(self.score_window(), "window") if anomalies else self.score_window()
            return R.label_lookahead(scored, self.p.event_share, self.p.lookahead_days)

        return self.store.table(name, build)

    def score_as_of(self) -> DataFrame:
        """Rule scores of the last week up to the as-of day with the final forecast."""
        p = self.p
        tail = R.inventory_tail(self.inventory_cedis(), p.as_of)
        as_of = F.lit(p.as_of)
        demand = R.daily_forecast(
            self.forecast("final"), self.daily(), p.as_of, F.date_sub(as_of, 7), F.date_add(as_of, p.lookahead_days)
        )
        return R.score_days(tail, demand, self.daily(), self.series(), p.prob_threshold, p.lookahead_days)

    def alerts(self, anomalies: bool = True) -> DataFrame:
        def build() -> DataFrame:
            if anomalies:
                return R.alert_list(self._with_anomalies(self.score_as_of(), "asof"), self.p.as_of)
            return R.alert_list(self.score_as_of(), self.p.as_of, ("cover", "prob"))

        return self.store.table(f"alerts_{anomalies}_{self.tag}", build)

    # ------------------------------------------------------------------ orders
    def orders(self) -> DataFrame:
        return self.store.table(f"orders_{self.tag}", lambda: O.build_orders(
            self.forecast("final"), self.series(), self.weekly(), self.daily(), self.p
        ))

    def order_summary(self) -> DataFrame:
        return self.store.table(f"order_summary_{self.tag}", lambda: O.summarize(self.orders()))

    # ------------------------------------------------------------------ gates
    def method_metrics(self, anomalies: bool = True) -> DataFrame:
        methods = R.METHODS if anomalies else ("cover", "prob")
        return self.store.table(f"methods_{anomalies}_{self.tag}", lambda: R.evaluate_methods(self.labeled(anomalies), methods))

    def gates(self, area: str, anomalies: bool = True) -> DataFrame:
        """The unscored gates of one area."""
        if area == "data":
            return G.data_gates(self.daily(), self.weekly(), self.series(), self.p)
        if area == "forecast":
            calibrated = self.holdout().filter("quantiles = 'calibrated'").drop("quantiles")
            return G.forecast_gates(
                self.forecast("final"), self.series(), self.metrics_of("cluster"), self.selection(), calibrated, self.calibration(), self.p
            )
        if area == "blind":
            return G.blind_gates(self.blind_regret(), self.blind_overall(), self.p)
        if area == "risk":
            return G.risk_gates(self.method_metrics(anomalies), self.alerts(anomalies), self.series(), self.p, len(R.METHODS))
        return G.order_gates(self.orders(), self.series(), self.order_summary(), self.p)

    def scorecard(self, anomalies: bool = True) -> DataFrame:
        areas = ("data", "forecast", "blind", "risk", "orders")
        return self.store.table(
            f"scorecard_{anomalies}_{self.tag}", lambda: G.scorecard(B.union_models([self.gates(a, anomalies) for a in areas]))
        )
