"""Names for things that callers make by name: data sources, transforms, functions of SQL, aggregates and table functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.errors import InvalidArgument


class Registry:
    """Factories by name; a name is given once."""

    def __init__(self, what: str):
        self.what = what
        self._factories: dict[str, Callable] = {}

    def register(self, name: str, factory: Callable | None = None) -> Callable:
        """Register a factory, directly or as a decorator."""

        def add(found: Callable) -> Callable:
            if name in self._factories:
                raise InvalidArgument(f"there is a {self.what} {name}")
            self._factories[name] = found
            return found

        return add if factory is None else add(factory)

    def create(self, name: str, *args, **options):
        if name not in self._factories:
            raise InvalidArgument(f"no {self.what} {name}; there are {', '.join(self.names()) or 'none'}")
        return self._factories[name](*args, **options)

    def names(self) -> list[str]:
        return sorted(self._factories)


#: Sources: (spark, **options) -> DataFrame. Transforms: (**options) -> Transform.
SOURCES = Registry("source")
TRANSFORMS = Registry("transform")


def register_function(spark: SparkSession, name: str, parameters: list[tuple[str, str]], returns: str, body: str) -> None:
    """A function of SQL whose body is an expression of its parameters (name, type); the optimizer inlines it."""
    listed = ", ".join(f"{n} {kind}" for n, kind in parameters)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({listed}) RETURNS {returns} RETURN {body}")


def run_sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """A SQL statement over named DataFrames."""
    return spark.sql(statement, **tables)
