"""Menu, orders, kitchen and sales."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seatwise.functions.columns import (
    DELIVERED,
    LINE_STATUS,
    PREPARED,
    REQUESTED,
    decode_status,
    line_amount,
    period,
)
from seatwise.operators.joins import ordered
from seatwise.operators.keys import assign_ids

# Lines of a dish that go to a cook together, and the rows of a cook and preparation time that one range may hold.
PACK, GROUP = 256, 1 << 17
_DISH = ["dish_id", "name", "description", "prep_s", "price"]


def menu_by_category(
    dishes: DataFrame, categories: DataFrame, by: str = "category"
) -> DataFrame:
    """The menu in category order (``category`` or ``category_id``), then by dish name.

    ``heading`` holds the category in capitals on the first dish of each category, which
    is all a page needs to print group headings. It comes from one minimum per category;
    a large category is never gathered.
    """
    names = categories.select("category_id", F.col("name").alias("category"))
    menu = dishes.join(names, "category_id", "left")
    first = dishes.groupBy("category_id").agg(F.min(F.struct("name", "dish_id")).alias("_first"))
    is_first = F.struct("name", "dish_id") == F.col("_first")
    return ordered(
        menu.join(first, "category_id", "left").select(
            "category_id", "category", *_DISH, F.when(is_first, F.upper("category")).alias("heading")
        ),
        by, "name", "dish_id",
    )


def dishes_in_category(dishes: DataFrame, categories: DataFrame, category: str) -> DataFrame:
    wanted = categories.filter(F.col("name") == category).select("category_id")
    return ordered(dishes.join(wanted, "category_id").select(*_DISH), "name", "dish_id")


def _people(users: DataFrame, key: str, label: str) -> DataFrame:
    return users.select(F.col("user_id").alias(key), F.col("name").alias(label))


def order_list(orders: DataFrame, users: DataFrame) -> DataFrame:
    rows = orders.join(_people(users, "customer_id", "customer"), "customer_id").join(
        _people(users, "waiter_id", "waiter"), "waiter_id"
    )
    return ordered(rows.select("order_id", "customer", "waiter", "table_id"), "order_id")


def _lines_with_dish(lines: DataFrame, dishes: DataFrame) -> DataFrame:
    return lines.join(
        dishes.select("dish_id", F.col("name").alias("dish"), "prep_s", "price"), "dish_id"
    )


def _line_key(lines: DataFrame) -> list[str]:
    """The line id, or the line number of sources that have no line id."""
    return ["line_id"] if "line_id" in lines.columns else ["line_no"]


def order_detail(
    orders: DataFrame, lines: DataFrame, users: DataFrame, dishes: DataFrame,
    labels: dict[int, str] = LINE_STATUS,
) -> DataFrame:
    """Every order line with customer, waiter, dish and status label.

    People are joined to the orders before the lines, on the smaller table.
    """
    heads = orders.join(_people(users, "customer_id", "customer"), "customer_id").join(
        _people(users, "waiter_id", "waiter"), "waiter_id"
    )
    rows = _lines_with_dish(lines, dishes).join(heads, "order_id")
    return ordered(
        rows.select(
            "order_id", "customer", "waiter", "table_id", *_line_key(lines), "dish", "qty",
            decode_status("status", labels).alias("status"), "requested",
        ),
        "order_id", *_line_key(lines),
    )


def customer_orders(
    orders: DataFrame, lines: DataFrame, users: DataFrame, dishes: DataFrame,
    customer_id: int | None = None, labels: dict[int, str] = LINE_STATUS,
) -> DataFrame:
    """Order lines of one customer, or of all."""
    if customer_id is not None:
        orders = orders.filter(F.col("customer_id") == customer_id)
    heads = orders.join(_people(users, "customer_id", "customer"), "customer_id")
    rows = _lines_with_dish(lines, dishes).join(
        heads.select("order_id", "customer_id", "customer", "table_id"), "order_id"
    )
    return ordered(
        rows.select(
            "customer_id", "customer", "order_id", "table_id", *_line_key(lines), "dish", "qty",
            decode_status("status", labels).alias("status"), "requested",
        ),
        "customer_id", "order_id", *_line_key(lines),
    )


def _coded(key: str) -> Column:
    """A line in one number: order, line, quantity and day, of which the lowest 31, 8, 8 and 16 bits are kept."""
    day = F.unix_date(F.col("requested").cast("date")).cast("long")
    code = day.bitwiseAND(0xFFFF)
    for name, bits, at in (("qty", 0xFF, 16), (key, 0xFF, 24), ("order_id", 0x7FFFFFFF, 32)):
        code = code.bitwiseOR(F.shiftleft(F.col(name).cast("long").bitwiseAND(bits), at))
    return code


def _decoded(code: Column, key: str, types: dict) -> dict[str, Column]:
    """What ``_coded`` kept. A line that differs from it does not fit into a number."""
    part = lambda at, bits: F.shiftright(code, at).bitwiseAND(bits)
    day = F.date_from_unix_date(code.bitwiseAND(0xFFFF).cast("int"))
    of = {"requested": day, "order_id": part(32, 0x7FFFFFFF), key: part(24, 0xFF), "qty": part(16, 0xFF)}
    return {name: c.cast(types[name]) for name, c in of.items()}


def _either(code: Column, wide: Column, key: str, types: dict) -> dict[str, Column]:
    """The columns of a line that is a number or, where it does not fit, a struct."""
    return {name: F.when(code.isNotNull(), c).otherwise(wide[name]) for name, c in _decoded(code, key, types).items()}


def kitchen_queue(
    lines: DataFrame, dishes: DataFrame, specialties: DataFrame, cook_id: int | None = None
) -> DataFrame:
    """Requested lines that each cook (or one cook) can prepare, longest preparation first.

    The lines of a dish go to its cooks together, in packs of about ``PACK`` lines, so that what all lines of a dish share is
    shuffled once for a cook, and small numbers take few bytes (``_coded``). Ranges are cut between cooks and preparation
    times; lines are taken out and sorted within them. Lines of a cook and time that are more than ``GROUP`` go one by
    one, so that ranges are also cut between them.
    """
    if cook_id is not None:
        specialties = specialties.filter(F.col("cook_id") == cook_id)
    key = _line_key(lines)
    order = ["requested", "order_id", *key]
    kept = [*order, "qty"]
    types = {c: lines.schema[c].dataType for c in kept}
    pending = lines.filter(F.col("status") == REQUESTED).select("dish_id", *kept)
    pairs = specialties.select("cook_id", "dish_id")
    named = dishes.select("dish_id", F.col("name").alias("dish"), "prep_s")
    # Broadcast: at most a row for every PACK lines, and one for every GROUP rows of the result.
    counts = pending.groupBy("dish_id").agg(F.count("*").alias("_n"))
    many = counts.filter(F.col("_n") > PACK).select(F.col("dish_id").alias("_many"), F.ceil(F.col("_n") / PACK).alias("_packs"))
    crowds = pairs.join(counts, "dish_id").join(named.select("dish_id", "prep_s"), "dish_id").groupBy(
        F.col("cook_id").alias("_cook"), F.col("prep_s").alias("_prep")).agg(F.sum("_n").alias("_rows"))
    crowds = F.broadcast(crowds.filter(F.col("_rows") > GROUP))

    code = _coded(key[0])
    fits = reduce(and_, [c.eqNullSafe(F.col(name)) for name, c in _decoded(F.col("_code"), key[0], types).items()])
    packs = pending.join(F.broadcast(many), F.col("dish_id") == F.col("_many"), "left").select(
        "dish_id", *kept, F.coalesce(F.pmod(F.xxhash64(*kept), "_packs"), F.lit(0)).alias("_part"), code.alias("_code"))
    packs = packs.withColumn("_code", F.when(fits, F.col("_code")))
    packs = packs.groupBy("dish_id", "_part", F.col("_code").isNull().alias("_odd")).agg(
        F.collect_list("_code").alias("_codes"),
        F.collect_list(F.when(F.col("_code").isNull(), F.struct(*kept))).alias("_wide"))

    rows = packs.select("dish_id", "_codes", "_wide").join(named, "dish_id").join(pairs, "dish_id")
    rows = rows.join(crowds, F.col("cook_id").eqNullSafe(F.col("_cook")) & F.col("prep_s").eqNullSafe(F.col("_prep")), "left")
    alone = F.col("_rows").isNotNull().alias("_alone")

    def cut(name: str) -> Column:
        """The pack as a whole, or each of its lines as a pack."""
        return F.when(F.col("_alone"), F.transform(name, lambda x: F.array(x))).otherwise(F.array(name)).alias(name)

    packed = ["cook_id", "dish", "prep_s", "_codes", "_wide"]
    rows = rows.select(*packed, alone).select("cook_id", "dish", "prep_s", "_alone", F.inline(F.arrays_zip(cut("_codes"), cut("_wide"))))
    first = _either(F.get("_codes", F.lit(0)), F.get("_wide", F.lit(0)), key[0], types)
    rows = rows.select(*packed, *[F.when(F.col("_alone"), first[c]).alias(f"_{c}") for c in order])
    by = [F.asc_nulls_last("cook_id"), F.desc_nulls_first("prep_s")]
    rows = rows.repartitionByRange(*by, *[F.asc_nulls_last(f"_{c}") for c in order])

    empty = [F.coalesce(c, F.array().cast(rows.schema[c].dataType)).alias(c) for c in packed[3:]]
    rows = rows.select("cook_id", "dish", "prep_s", F.inline(F.arrays_zip(*empty)))
    line = _either(F.col("_codes"), F.col("_wide"), key[0], types)
    rows = rows.select("cook_id", *[line[c].alias(c) for c in ("order_id", *key)], "dish", "prep_s",
                       line["qty"].alias("qty"), line["requested"].alias("requested"))
    return rows.sortWithinPartitions(*by, *[F.asc_nulls_last(c) for c in order])


def kitchen_next(lines: DataFrame, dishes: DataFrame, specialties: DataFrame) -> DataFrame:
    """Per cook the first line of ``kitchen_queue``: the longest preparation, then the oldest request.

    The first line of each dish is found before cooks come in, so that lines and cooks
    never multiply.
    """
    key = _line_key(lines)
    order = F.struct("requested", "order_id", *key, "qty")
    first = lines.filter(F.col("status") == REQUESTED).groupBy("dish_id").agg(F.min(order).alias("_line"))
    rows = first.join(
        dishes.select("dish_id", F.col("name").alias("dish"), "prep_s"), "dish_id"
    ).join(specialties.select("cook_id", "dish_id"), "dish_id")
    best = F.min(F.struct(-F.col("prep_s"), "_line.requested", "_line.order_id", *[f"_line.{k}" for k in key], "_line.qty", "dish"))
    found = rows.groupBy("cook_id").agg(best.alias("_b"))
    return ordered(found.select("cook_id", *[f"_b.{c}" for c in ("order_id", *key, "dish", "qty", "requested")]), "cook_id")


def kitchen_first(lines: DataFrame, dishes: DataFrame, specialties: DataFrame, k: int = 5) -> DataFrame:
    """Per cook the first ``k`` lines of ``kitchen_queue`` and their ``place``.

    Only the first k lines of a dish can be among them, and all lines of a dish wait equally long, so each dish is cut to
    k lines, and dishes are ranked by their first line, before cooks come in. The first k lines of a cook are of the
    k first dishes; these are cut by (cook, rank) alone, and their lines come in after that. All cuts are made within each
    task before the shuffle, and the work grows with lines plus cook-dish pairs plus k * k rows for a cook.
    """
    key = _line_key(lines)
    age = ["requested", "order_id", *key, "qty"]
    pending = lines.filter(F.col("status") == REQUESTED).select("dish_id", *age)
    in_dish = F.row_number().over(Window.partitionBy("dish_id").orderBy(*age))
    oldest = pending.withColumn("_place", in_dish).filter(F.col("_place") <= k)
    heads = oldest.groupBy("dish_id").agg(F.sort_array(F.collect_list(F.struct(*age))).alias("_lines"))
    heads = heads.join(dishes.select("dish_id", F.col("name").alias("dish"), "prep_s"), "dish_id").select(
        "*", F.col("prep_s").isNull().alias("_unknown"), (-F.col("prep_s")).alias("_sooner"), F.col("_lines")[0].alias("_first"))
    ranked = assign_ids(heads, "_rank", ["_unknown", "_sooner", "_first", "dish"])
    pairs = specialties.select("cook_id", "dish_id").join(ranked.select("dish_id", "_rank"), "dish_id").select("cook_id", "_rank")
    of_cook = Window.partitionBy("cook_id")
    nearest = pairs.withColumn("_place", F.row_number().over(of_cook.orderBy("_rank"))).filter(F.col("_place") <= k)
    rows = nearest.select("cook_id", "_rank").join(ranked.select("_rank", "dish", "prep_s", "_lines"), "_rank").select(
        "cook_id", "dish", "prep_s", F.inline("_lines"))
    in_queue = F.row_number().over(of_cook.orderBy(F.desc("prep_s"), *age, "dish")).cast("long")
    found = rows.withColumn("place", in_queue).filter(F.col("place") <= k)
    return ordered(
        found.select("cook_id", "place", "order_id", *key, "dish", "prep_s", "qty", "requested"), "cook_id", "place"
    )


def kitchen_panel(
    orders: DataFrame, lines: DataFrame, users: DataFrame, dishes: DataFrame,
    specialties: DataFrame, cook_id: int | None = None, labels: dict[int, str] = LINE_STATUS,
) -> DataFrame:
    """Waiting lines that some cook (or one cook) can prepare, oldest first, with customer
    and table. Each line once: the table is the order's own."""
    if cook_id is not None:
        specialties = specialties.filter(F.col("cook_id") == cook_id)
    pending = lines.filter(F.col("status") == REQUESTED).join(
        specialties.select("dish_id").distinct(), "dish_id", "left_semi"
    )
    heads = orders.join(_people(users, "customer_id", "customer"), "customer_id")
    rows = _lines_with_dish(pending, dishes).join(
        heads.select("order_id", "customer", "table_id"), "order_id"
    )
    return ordered(
        rows.select(
            "order_id", *_line_key(lines), "dish",
            decode_status("status", labels).alias("status"),
            "qty", "customer", "table_id", "requested",
        ),
        "requested", "order_id", *_line_key(lines),
    )


def kitchen_load(lines: DataFrame, dishes: DataFrame, specialties: DataFrame) -> DataFrame:
    """Per cook: waiting lines, units, and the longest preparation among them.

    Lines are summed per dish before cooks come in, so the work grows with lines plus
    cook-dish pairs, not with their product.
    """
    waiting = (
        lines.filter(F.col("status") == REQUESTED)
        .groupBy("dish_id")
        .agg(F.count("*").alias("_lines"), F.sum("qty").alias("_qty"))
    )
    rows = waiting.join(dishes.select("dish_id", "prep_s"), "dish_id").join(
        specialties.select("cook_id", "dish_id"), "dish_id"
    )
    return ordered(
        rows.groupBy("cook_id").agg(
            F.sum("_lines").alias("waiting_lines"),
            F.sum("_qty").alias("units"),
            F.max("prep_s").alias("longest_prep_s"),
        ),
        "cook_id",
    )


def ready_lines(
    orders: DataFrame, lines: DataFrame, users: DataFrame, dishes: DataFrame
) -> DataFrame:
    """Prepared lines with the table and waiter to bring them to."""
    ready = lines.filter(F.col("status") == PREPARED)
    heads = orders.join(_people(users, "waiter_id", "waiter"), "waiter_id")
    rows = _lines_with_dish(ready, dishes).join(
        heads.select("order_id", "table_id", "waiter"), "order_id"
    )
    return ordered(
        rows.select(
            "order_id", "table_id", "waiter", *_line_key(lines), "dish", "qty", "requested"
        ),
        "table_id", "requested", "order_id", *_line_key(lines),
    )


def delivered_lines(orders: DataFrame, lines: DataFrame, dishes: DataFrame) -> DataFrame:
    done = lines.filter(F.col("status") == DELIVERED)
    rows = _lines_with_dish(done, dishes).join(orders.select("order_id", "table_id"), "order_id")
    return ordered(
        rows.select(*_line_key(lines), "order_id", "table_id", "dish", "qty", "requested"),
        "requested", "order_id", *_line_key(lines),
    )


def dish_ranking(lines: DataFrame, dishes: DataFrame) -> DataFrame:
    """Dishes by units ordered, then by number of lines, then by name.

    Lines are summed per dish before the names are joined.
    """
    per_dish = lines.groupBy("dish_id").agg(
        F.sum("qty").alias("total_units"), F.count("*").alias("times_ordered")
    )
    rows = per_dish.join(dishes.select("dish_id", F.col("name").alias("dish")), "dish_id")
    return ordered(
        rows.select("dish_id", "dish", "total_units", "times_ordered"),
        "-total_units", "-times_ordered", "dish", "dish_id",
    )


def sales_by_period(lines: DataFrame, dishes: DataFrame, unit: str) -> DataFrame:
    """Value of delivered lines per calendar day, week or month of the request.

    Quantities are summed per period and dish before prices are joined.
    """
    sold = lines.filter(F.col("status") == DELIVERED)
    units = sold.groupBy(period("requested", unit).alias(unit), "dish_id").agg(F.sum("qty").alias("_qty"))
    rows = units.join(dishes.select("dish_id", "price"), "dish_id")
    return ordered(
        rows.groupBy(unit).agg(F.sum(line_amount("_qty", "price")).alias("total_sales")), unit
    )


def order_totals(lines: DataFrame, dishes: DataFrame) -> DataFrame:
    """Lines, units and value of each order, whatever the state of its lines."""
    units = lines.groupBy("order_id", "dish_id").agg(
        F.sum("qty").alias("_qty"), F.count("*").alias("_lines")
    )
    rows = units.join(dishes.select("dish_id", "price"), "dish_id")
    return ordered(
        rows.groupBy("order_id").agg(
            F.sum("_lines").alias("n_lines"), F.sum("_qty").alias("units"),
            F.sum(line_amount("_qty", "price")).alias("total"),
        ),
        "order_id",
    )


def daily_kpis(lines: DataFrame, dishes: DataFrame, day: str | None = None) -> DataFrame:
    """Per day: orders placed, the dish on most lines, and the value of all lines.

    An order belongs to the day of its first line. The star dish breaks ties by name.
    """
    lines = lines.filter(F.col("order_id").isNotNull())
    # Lines are read once and folded per order and dish; an order has at most a row per dish then.
    per = lines.groupBy("order_id", "dish_id").agg(
        F.count("*").alias("_n"), F.sum("qty").alias("_qty"), F.min("requested").alias("_first")
    )
    whole = Window.partitionBy("order_id")
    counts_order = F.row_number().over(whole.orderBy("dish_id")) == 1
    per = per.select(
        "dish_id", "_n", "_qty", F.min("_first").over(whole).cast("date").alias("day"),
        F.when(counts_order, 1).otherwise(0).alias("_order"),
    )
    if day is not None:
        per = per.filter(F.col("day") == F.lit(day).cast("date"))
    per_dish = (
        per.groupBy("day", "dish_id")
        .agg(F.sum("_n").alias("_n"), F.sum("_qty").alias("_qty"), F.sum("_order").alias("_orders"))
        .join(dishes.select("dish_id", "name", "price"), "dish_id", "left")
    )
    rank = F.when(F.col("name").isNotNull(), F.struct(-F.col("_n"), "name", "dish_id"))
    known = F.when(F.col("name").isNotNull(), F.col("_n"))
    totals = per_dish.groupBy("day").agg(
        F.sum("_orders").alias("total_orders"), F.min_by("name", rank).alias("star_dish"),
        F.max(known).alias("star_lines"), F.sum(line_amount("_qty", "price")).alias("gross_revenue"),
    )
    return ordered(totals.filter(F.col("star_dish").isNotNull()), "day")
