"""Per-call access to the canonical tables of one data folder."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .. import AS_OF_DEFAULT
from ..sources import tpch


class Catalog:
    """Lazily built canonical tables (plain lazy DataFrames: nothing is
    computed until an action runs, and Catalyst prunes unused columns)."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF_DEFAULT, materialize: bool = False, bounded: bool = True):
        """``bounded``: facts created after ``as_of`` are not visible.

        ``materialize``: tables read by several stages of one plan
        (batches) are written once to the shared checkpoint folder
        (``checkpoint``: reliable, lineage cut) instead of being recomputed
        from the movements by every consumer."""
        self.spark, self.sf_dir, self.as_of, self.materialize, self.bounded = spark, sf_dir, as_of, materialize, bounded

    def raw(self, name: str) -> DataFrame:
        return tpch.read(self.spark, self.sf_dir, name)

    @cached_property
    def depots(self) -> DataFrame:
        return tpch.depots(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        return tpch.products(self.spark, self.sf_dir)

    @cached_property
    def movements(self) -> DataFrame:
        return tpch.stock_movements(self.spark, self.sf_dir, self.as_of, self.bounded)

    @cached_property
    def batches(self) -> DataFrame:
        b = tpch.batches(self.spark, self.sf_dir, self.as_of, self.movements)
        return b.checkpoint(eager=True) if self.materialize else b

    @cached_property
    def invoices(self) -> DataFrame:
        return tpch.invoices(self.spark, self.sf_dir, self.as_of, self.bounded)

    @cached_property
    def payments(self) -> DataFrame:
        return tpch.payments(self.spark, self.sf_dir, self.as_of, self.invoices, self.bounded)

    @cached_property
    def payment_transactions(self) -> DataFrame:
        return tpch.payment_transactions(self.spark, self.sf_dir, self.as_of)

    @cached_property
    def retailers(self) -> DataFrame:
        return tpch.retailers(self.spark, self.sf_dir)

    @cached_property
    def readings(self) -> DataFrame:
        return tpch.readings(self.spark, self.sf_dir)

    @cached_property
    def discount_schemes(self) -> DataFrame:
        return tpch.discount_schemes(self.spark, self.sf_dir)

    @cached_property
    def invoice_lines(self) -> DataFrame:
        return tpch.invoice_line_items(self.spark, self.sf_dir)
