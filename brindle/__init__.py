"""A dataframe engine on Spark: ordered tables, typed expressions, and operators that compile to Catalyst plans."""

from brindle.expr import (
    Expr,
    all_,
    all_horizontal,
    any_horizontal,
    arctan2,
    as_struct,
    business_day_count,
    by_dtype,
    coalesce,
    col,
    columns,
    concat_str,
    corr,
    cov,
    date_,
    datetime_,
    duration,
    exclude,
    first_,
    grouping,
    grouping_id,
    int_range,
    last_,
    len_,
    lit,
    max_horizontal,
    mean_horizontal,
    min_horizontal,
    nth,
    null,
    sum_horizontal,
    time_,
    when,
)
from brindle.frame import Frame, Series, concat, date_range, datetime_range, from_arrow

__all__ = ["Expr", "Frame", "Series", "all_", "all_horizontal", "any_horizontal", "arctan2", "as_struct", "business_day_count", "by_dtype", "coalesce", "col", "columns", "concat", "concat_str", "corr", "cov", "date_", "date_range", "datetime_", "datetime_range", "duration", "exclude", "first_", "from_arrow", "grouping", "grouping_id", "int_range", "last_", "len_", "lit", "max_horizontal", "mean_horizontal", "min_horizontal", "nth", "null", "sum_horizontal", "time_", "when"]
