"""Demand forecasting, stock-out risk and replenishment as Spark DataFrame operators."""

from stockweave.params import Params

__all__ = ["Params"]
