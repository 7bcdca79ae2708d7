"""SQL for each registered query over the test tables, written for DuckDB.

The SQL states each answer directly (theta joins, correlated counts, row-by-row
recursion) and shares no logic with the Spark operators.
"""

from __future__ import annotations

_MODEL = {
    "users": "SELECT c_custkey AS user_id, c_name AS name, lower(c_name) AS login FROM customer",
    "roles": "SELECT * FROM (VALUES (1, 'ADMIN'), (2, 'MAITRE'), (3, 'WAITER'), (4, 'COOK'), "
             "(5, 'CUSTOMER')) AS v(role_id, name)",
    "role_assignments": "SELECT least(c_custkey % 10, 4) + 1 AS role_id, c_custkey AS user_id FROM customer",
    "user_roles": "SELECT user_id, name AS role FROM role_assignments JOIN roles USING (role_id)",
    "dining_tables": "SELECT s_suppkey AS table_id, CAST(2 + 2 * (s_suppkey % 4) AS INTEGER) AS seats FROM supplier",
    "n": "SELECT count(*) AS n FROM supplier",
    "ev": "SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events",
    "bookings": "SELECT event_id AS booking_id, user_id AS customer_id, "
                "CAST(1 + CAST(round(value * 100) AS BIGINT) % 8 AS INTEGER) AS party_size, "
                "CASE event_type WHEN 'purchase' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 4 ELSE 1 END AS status "
                "FROM events",
    "slots": "SELECT event_id AS slot_id, (user_id + 13 * k) % (SELECT n FROM n) AS table_id, "
             "event_id AS booking_id, ts AS start, 1800 * (1 + event_id % 4) AS duration_s, "
             "ts + to_seconds(1800 * (1 + event_id % 4)) AS finish FROM ev",
    "booked": "SELECT s.*, b.customer_id, b.party_size, b.status FROM slots s JOIN bookings b USING (booking_id)",
    "hours": "SELECT DISTINCT date_trunc('hour', start) AS at FROM slots",
    "floor_orders": "SELECT event_id AS order_id, user_id AS customer_id, "
                    "(user_id + 13 * k) % (SELECT n FROM n) AS table_id, ts + to_seconds(600) AS placed FROM ev "
                    "WHERE event_type = 'purchase'",
    "categories": "SELECT row_number() OVER (ORDER BY name) AS category_id, name "
                  "FROM (SELECT DISTINCT p_type AS name FROM part)",
    "dishes": "SELECT p_partkey AS dish_id, c.category_id, c.name AS category, p_name AS name, p_brand AS description, "
              "CAST(60 * p_size AS BIGINT) AS prep_s, CAST(p_retailprice AS DECIMAL(12,2)) AS price "
              "FROM part JOIN categories c ON c.name = p_type",
    "ords": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderkey % 150 AS waiter_id, "
            "(o_orderkey * 13 + 5) % (SELECT n FROM n) AS table_id FROM orders",
    "order_lines": "SELECT l_orderkey AS order_id, l_partkey AS dish_id, l_linenumber AS line_no, "
                   "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END AS status, "
                   "CAST(l_quantity AS BIGINT) AS qty, l_shipdate AS requested FROM lineitem",
    "numbered": "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, "
                "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_id FROM lineitem",
    "preparations": "SELECT l_suppkey AS cook_id, line_id FROM numbered",
    "specialties": "SELECT DISTINCT l_suppkey AS cook_id, l_partkey AS dish_id FROM lineitem",
    "forms": "SELECT o_orderkey AS form_id, o_custkey AS customer_id, o_orderkey % 150 AS waiter_id, "
             "(o_orderkey * 13 + 5) % (SELECT n FROM n) AS table_id, i, (o_orderkey * 7 + 11 * i) % 200 AS dish_id, "
             "(o_orderkey + i) % 5 - 2 AS qty FROM orders CROSS JOIN (VALUES (0), (1), (2)) AS v(i)",
}
_DEPENDS = {
    "user_roles": ["roles", "role_assignments"], "slots": ["n", "ev"], "booked": ["slots", "bookings"],
    "hours": ["slots"], "floor_orders": ["n", "ev"], "dishes": ["categories"], "ords": ["n"], "forms": ["n"],
    "preparations": ["numbered"],
}


def _sql(body: str, *tables: str, recursive: bool = False) -> str:
    """``body`` preceded by the mapped tables it uses."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in _DEPENDS.get(name, []):
            add(dep)
        if name not in wanted:
            wanted.append(name)

    for name in tables:
        add(name)
    ctes = ", ".join(f"{name} AS ({_MODEL[name]})" for name in wanted)
    if not ctes:
        return body
    if body.startswith("WITH "):
        body = ", " + body.removeprefix("WITH ")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"


_BOOKING_LABEL = ("CASE b.status WHEN 1 THEN 'reserved' WHEN 2 THEN 'occupied' WHEN 3 THEN 'released' "
                  "WHEN 4 THEN 'cancelled' END")
_LINE_LABEL = "CASE l.status WHEN 1 THEN 'requested' WHEN 2 THEN 'prepared' WHEN 3 THEN 'delivered' END"
AS_OF = "TIMESTAMP '2024-01-15 12:45:00'"

ORACLES: dict[str, str] = {}


def _period(unit: str, expr: str) -> str:
    return f"CAST(date_trunc('{unit}', {expr}) AS DATE)"


ORACLES["list_tables"] = _sql("SELECT table_id, seats FROM dining_tables", "dining_tables")
ORACLES["total_seats"] = _sql("SELECT CAST(sum(seats) AS BIGINT) AS total_seats FROM dining_tables", "dining_tables")
ORACLES["tables_with_bookings"] = _sql(
    'SELECT t.table_id, t.seats, s.start, s.finish AS "end", b.booking_id, b.party_size FROM dining_tables t '
    "LEFT JOIN slots s ON s.table_id = t.table_id LEFT JOIN bookings b ON b.booking_id = s.booking_id",
    "dining_tables", "slots", "bookings")
ORACLES["booking_list"] = _sql(
    f"SELECT b.booking_id, u.name AS customer, b.party_size, {_BOOKING_LABEL} AS status, s.table_id, s.start, "
    's.duration_s, s.finish AS "end" FROM bookings b JOIN users u ON u.user_id = b.customer_id '
    "LEFT JOIN slots s ON s.booking_id = b.booking_id", "bookings", "users", "slots")
ORACLES["customer_bookings"] = _sql(
    f"SELECT b.customer_id, u.name AS customer, b.booking_id, b.party_size, {_BOOKING_LABEL} AS status, s.table_id, "
    "s.start FROM bookings b JOIN users u ON u.user_id = b.customer_id "
    "LEFT JOIN slots s ON s.booking_id = b.booking_id", "bookings", "users", "slots")
ORACLES["table_availability"] = _sql(
    "WITH r AS (SELECT event_id AS request_id, (user_id * 3 + k) % (SELECT n FROM n) AS table_id, "
    "ts + to_seconds(3600) AS start, CAST(7200 AS BIGINT) AS duration_s, ts + to_seconds(10800) AS finish FROM ev) "
    "SELECT request_id, r.table_id, any_value(r.start) AS start, any_value(r.duration_s) AS duration_s, "
    'any_value(r.finish) AS "end", if(count(b.slot_id) = 0, \'AVAILABLE\', \'NOT AVAILABLE\') AS availability '
    "FROM r LEFT JOIN (FROM booked WHERE status IN (1, 2, 3)) b ON r.table_id = b.table_id "
    "AND greatest(b.start, r.start) < least(b.finish, r.finish) GROUP BY request_id, r.table_id", "booked")
ORACLES["overlap_pairs"] = _sql(
    "SELECT event_id AS request_id, s.slot_id, s.table_id AS place FROM ev JOIN booked s ON s.table_id = (user_id * 3 + k) % (SELECT n FROM n) "
    "AND event_id % 10 <> 0 AND s.start < ts + to_seconds(10800) AND s.finish > ts + to_seconds(3600) "
    "UNION ALL SELECT event_id, s.slot_id, -event_id - 1 FROM ev JOIN booked s ON s.booking_id = event_id "
    "AND event_id % 10 = 0 AND s.start < ts + to_seconds(1826 * 86400 + 3600) AND s.finish > ts - to_seconds(1826 * 86400 - 3600)",
    "booked")
ORACLES["capacity_usage"] = _sql(
    "SELECT h.at AS start, CAST(7200 AS BIGINT) AS duration_s, h.at + to_seconds(7200) AS \"end\", "
    "CAST(coalesce(sum(b.party_size), 0) AS BIGINT) AS people_booked, "
    "(SELECT CAST(sum(seats) AS BIGINT) FROM dining_tables) AS total_seats FROM hours h "
    "LEFT JOIN booked b ON b.status IN (1, 2) AND b.start < h.at + to_seconds(7200) AND h.at < b.finish "
    "GROUP BY h.at", "booked", "hours", "dining_tables")
ORACLES["overlap_sum_all"] = _sql(
    "SELECT a.slot_id, CAST(sum(b.party_size) AS BIGINT) AS people FROM booked a JOIN booked b "
    "ON a.start < b.finish AND b.start < a.finish WHERE a.status <> 4 AND b.status <> 4 GROUP BY a.slot_id", "booked")
# An hour's first 30 minutes are those less than 1,801 s after it.
_UPCOMING = (
    "WITH due AS (SELECT *, epoch(start) - epoch(date_trunc('hour', start)) AS after FROM booked WHERE status = 1) "
    "SELECT date_trunc('hour', start) AS at, booking_id, (SELECT name FROM users WHERE user_id = due.customer_id) AS customer, "
    'table_id, start, finish AS "end" FROM due WHERE after <= 1800')
ORACLES["upcoming_bookings"] = _sql(_UPCOMING, "booked", "hours", "users")


def _board(at: str, extra: str = "") -> str:
    """One row per (table, slot now in use); the state from two flags, in order of rank."""
    return _sql(
        f"WITH clock AS (SELECT {at} AS t), "
        "guests AS (SELECT DISTINCT customer_id FROM floor_orders, clock WHERE date_trunc('day', placed) = date_trunc('day', t)), "
        "using_now AS (SELECT table_id, customer_id, customer_id IN (FROM guests) AS has_ordered FROM booked, clock "
        "WHERE start <= t AND finish >= t) "
        "SELECT d.table_id, d.seats, list_extract(['Free', 'Reserved', 'Occupied'], "
        "1 + CAST(n.customer_id IS NOT NULL AS INTEGER) + CAST(coalesce(n.has_ordered, false) AS INTEGER)) AS state, "
        f"users.name AS customer{extra} FROM dining_tables d LEFT JOIN using_now n USING (table_id) "
        "LEFT JOIN users ON users.user_id = n.customer_id",
        "dining_tables", "booked", "users", "floor_orders")


ORACLES["table_board"] = _board(AS_OF)
ORACLES["table_board_now"] = _board("CAST(now() AS TIMESTAMP)")
ORACLES["seated_customers"] = _sql(
    f"SELECT b.customer_id, u.name, b.booking_id, b.table_id FROM booked b JOIN users u ON u.user_id = b.customer_id "
    f"WHERE {AS_OF} BETWEEN b.start AND b.finish", "booked", "users")
ORACLES["seated_customers_each"] = _sql(
    "SELECT h.at, b.customer_id, u.name, b.booking_id, b.table_id FROM hours h JOIN booked b "
    "ON h.at BETWEEN b.start AND b.finish JOIN users u ON u.user_id = b.customer_id", "booked", "hours", "users")
for _unit in ("day", "week", "month"):
    ORACLES[f"bookings_by_{_unit}"] = _sql(
        f"SELECT {_period(_unit, 'start')} AS {_unit}, count(*) AS total_bookings, "
        "CAST(sum(party_size) AS BIGINT) AS total_people FROM booked GROUP BY 1", "booked")
    ORACLES[f"sales_by_{_unit}"] = _sql(
        f"SELECT {_period(_unit, 'l.requested')} AS {_unit}, sum(l.qty * d.price) AS total_sales FROM order_lines l "
        "JOIN dishes d USING (dish_id) WHERE l.status = 3 GROUP BY 1", "order_lines", "dishes")
ORACLES["booking_order_history"] = _sql(
    "SELECT b.booking_id, u.name AS customer, b.status, s.table_id, o.order_id, o.placed FROM bookings b "
    "JOIN users u ON u.user_id = b.customer_id LEFT JOIN slots s ON s.booking_id = b.booking_id "
    "LEFT JOIN floor_orders o ON o.customer_id = b.customer_id AND o.table_id = s.table_id "
    "AND o.placed BETWEEN s.start AND s.finish", "bookings", "users", "slots", "floor_orders")

ORACLES["menu_by_category"] = _sql(
    "SELECT category_id, category, dish_id, name, description, prep_s, price, CASE WHEN row_number() OVER "
    "(PARTITION BY category_id ORDER BY name, dish_id) = 1 THEN upper(category) END AS heading FROM dishes", "dishes")
ORACLES["dishes_in_category"] = _sql(
    "SELECT dish_id, name, description, prep_s, price FROM dishes WHERE category = 'PROMO'", "dishes")
ORACLES["order_list"] = _sql(
    "SELECT o.order_id, c.name AS customer, w.name AS waiter, o.table_id FROM ords o "
    "JOIN users c ON c.user_id = o.customer_id JOIN users w ON w.user_id = o.waiter_id", "ords", "users")
ORACLES["order_detail"] = _sql(
    f"SELECT o.order_id, c.name AS customer, w.name AS waiter, o.table_id, l.line_no, d.name AS dish, l.qty, "
    f"{_LINE_LABEL} AS status, l.requested FROM ords o JOIN users c ON c.user_id = o.customer_id "
    "JOIN users w ON w.user_id = o.waiter_id JOIN order_lines l ON l.order_id = o.order_id "
    "JOIN dishes d ON d.dish_id = l.dish_id", "ords", "users", "order_lines", "dishes")
ORACLES["customer_orders"] = _sql(
    f"SELECT o.customer_id, c.name AS customer, o.order_id, o.table_id, l.line_no, d.name AS dish, l.qty, "
    f"{_LINE_LABEL} AS status, l.requested FROM ords o JOIN users c ON c.user_id = o.customer_id "
    "JOIN order_lines l ON l.order_id = o.order_id JOIN dishes d ON d.dish_id = l.dish_id",
    "ords", "users", "order_lines", "dishes")
ORACLES["kitchen_queue"] = _sql(
    "SELECT e.cook_id, l.order_id, l.line_no, d.name AS dish, d.prep_s, l.qty, l.requested FROM order_lines l "
    "JOIN dishes d USING (dish_id) JOIN specialties e USING (dish_id) WHERE l.status = 1",
    "order_lines", "dishes", "specialties")
ORACLES["kitchen_first"] = _sql(
    "WITH q AS (SELECT e.cook_id, l.order_id, l.line_no, d.name AS dish, d.prep_s, l.qty, l.requested, row_number() OVER ("
    "PARTITION BY e.cook_id ORDER BY d.prep_s DESC, l.requested, l.order_id, l.line_no, l.qty, d.name) AS place FROM order_lines l "
    "JOIN dishes d USING (dish_id) JOIN specialties e USING (dish_id) WHERE l.status = 1) FROM q WHERE place <= 5",
    "order_lines", "dishes", "specialties")
ORACLES["kitchen_next"] = _sql(
    "WITH q AS (SELECT e.cook_id, l.order_id, l.line_no, d.name AS dish, l.qty, l.requested, row_number() OVER (PARTITION BY "
    "e.cook_id ORDER BY d.prep_s DESC, l.requested, l.order_id, l.line_no, l.qty, d.name) AS r FROM order_lines l "
    "JOIN dishes d USING (dish_id) JOIN specialties e USING (dish_id) WHERE l.status = 1) "
    "SELECT cook_id, order_id, line_no, dish, qty, requested FROM q WHERE r = 1", "order_lines", "dishes", "specialties")
ORACLES["kitchen_panel"] = _sql(
    f"SELECT l.order_id, l.line_no, d.name AS dish, {_LINE_LABEL} AS status, l.qty, c.name AS customer, o.table_id, "
    "l.requested FROM order_lines l JOIN dishes d USING (dish_id) JOIN ords o USING (order_id) "
    "JOIN users c ON c.user_id = o.customer_id WHERE l.status = 1 "
    "AND EXISTS (SELECT 1 FROM specialties e WHERE e.dish_id = l.dish_id)",
    "order_lines", "dishes", "ords", "users", "specialties")
ORACLES["kitchen_load"] = _sql(
    "SELECT e.cook_id, count(*) AS waiting_lines, CAST(sum(l.qty) AS BIGINT) AS units, max(d.prep_s) AS longest_prep_s "
    "FROM order_lines l JOIN dishes d USING (dish_id) JOIN specialties e USING (dish_id) WHERE l.status = 1 "
    "GROUP BY e.cook_id", "order_lines", "dishes", "specialties")
_READY = (
    "SELECT l.order_id, o.table_id, w.name AS waiter{line}, d.name AS dish, l.qty, l.requested{extra} FROM order_lines l "
    "JOIN ords o USING (order_id) JOIN users w ON w.user_id = o.waiter_id JOIN dishes d USING (dish_id) "
    "WHERE l.status = 2")
ORACLES["ready_lines"] = _sql(
    _READY.format(line=", l.line_no", extra=""), "order_lines", "ords", "users", "dishes")
ORACLES["delivered_lines"] = _sql(
    "SELECT l.line_no, l.order_id, o.table_id, d.name AS dish, l.qty, l.requested FROM order_lines l "
    "JOIN ords o USING (order_id) JOIN dishes d USING (dish_id) WHERE l.status = 3", "order_lines", "ords", "dishes")
ORACLES["order_totals"] = _sql(
    "SELECT l.order_id, count(*) AS n_lines, CAST(sum(l.qty) AS BIGINT) AS units, sum(l.qty * d.price) AS total "
    "FROM order_lines l JOIN dishes d USING (dish_id) GROUP BY 1", "order_lines", "dishes")
_RANKING = (
    "SELECT d.dish_id, d.name AS dish, CAST(sum(l.qty) AS BIGINT) AS total_units, count(*) AS times_ordered "
    "FROM order_lines l JOIN dishes d USING (dish_id) GROUP BY d.dish_id, d.name")
ORACLES["dish_ranking"] = _sql(_RANKING, "order_lines", "dishes")
ORACLES["top_dishes"] = _sql(
    _RANKING + " ORDER BY total_units DESC, times_ordered DESC, dish, dish_id LIMIT 10", "order_lines", "dishes")
ORACLES["daily_kpis"] = _sql(
    "WITH placed AS (SELECT order_id, CAST(min(requested) AS DATE) AS day FROM order_lines GROUP BY order_id), "
    "per_dish AS (SELECT p.day, d.name, d.dish_id, count(*) AS n, sum(l.qty * d.price) AS money FROM order_lines l "
    "JOIN placed p USING (order_id) JOIN dishes d USING (dish_id) GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, name, dish_id) AS r FROM per_dish) "
    "SELECT r.day, (SELECT count(*) FROM placed p WHERE p.day = r.day) AS total_orders, "
    "max(r.name) FILTER (r = 1) AS star_dish, max(r.n) AS star_lines, "
    "CAST(sum(r.money) AS DECIMAL(38,2)) AS gross_revenue FROM ranked r GROUP BY r.day", "order_lines", "dishes")
ORACLES["merged_day_figures"] = _sql(
    "WITH march AS (SELECT *, strftime(requested, '%Y-%m') = '1995-03' AS hit FROM order_lines), "
    "now AS (SELECT dish_id, qty, if(hit AND line_no = 1, 3, status) AS status, "
    "CAST(if(hit AND line_no = 3, requested + to_days(31), requested) AS DATE) AS day FROM march WHERE NOT (hit AND line_no = 2)), "
    "per AS (SELECT day, d.name, n.dish_id, count(*) AS n, sum(n.qty) AS qty, sum(n.qty * d.price) AS money, "
    "sum(if(n.status = 3, n.qty, 0) * d.price) AS sold FROM now n LEFT JOIN dishes d USING (dish_id) GROUP BY ALL), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, name, dish_id) AS r FROM per) "
    "SELECT day, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(qty) AS BIGINT) AS units, max(name) FILTER (r = 1) AS star_dish, "
    "CAST(sum(money) AS DECIMAL(38,2)) AS gross_revenue, CAST(sum(sold) AS DECIMAL(38,2)) AS total_sales FROM ranked GROUP BY day",
    "order_lines", "dishes")
ORACLES["format_amounts"] = _sql(
    "SELECT CAST(l.requested AS DATE) AS day, replace(format('{:,}', CAST(round(sum(l.qty * d.price), 0) AS BIGINT)), "
    "',', '.') AS total_sales FROM order_lines l JOIN dishes d USING (dish_id) WHERE l.status = 3 GROUP BY 1",
    "order_lines", "dishes")

ORACLES["staff_by_role"] = _sql(
    "SELECT r.role, u.user_id, u.name FROM user_roles r JOIN users u USING (user_id) WHERE r.role <> 'CUSTOMER'",
    "user_roles", "users")
ORACLES["user_directory"] = _sql(
    "SELECT u.user_id, u.name, u.login, r.role FROM users u LEFT JOIN user_roles r USING (user_id)",
    "user_roles", "users")
ORACLES["system_counts"] = (
    "SELECT (SELECT count(*) FROM customer) AS total_users, (SELECT count(*) FROM orders) AS total_orders")
ORACLES["cook_dishes"] = _sql(
    "SELECT e.cook_id, u.name AS cook, e.dish_id, d.name AS dish FROM specialties e "
    "JOIN users u ON u.user_id = e.cook_id JOIN dishes d USING (dish_id)", "specialties", "users", "dishes")
ORACLES["pseudonymise"] = "SELECT c_custkey AS user_id, sha256(lower(c_name)) AS login_digest FROM customer"


def _role(user: str, role: str) -> str:
    return f"EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = {user} AND r.role = '{role}')"


def _lacks(user: str, role: str) -> str:
    return f"concat('user ', {user}, ' lacks the role {role}')"


ORACLES["has_role"] = _sql(
    f"SELECT u.*, {_role('u.user_id', 'COOK')} AS is_cook FROM users u", "users", "user_roles")
ORACLES["check_bookings"] = _sql(
    f"SELECT b.*, CASE WHEN NOT {_role('b.customer_id', 'CUSTOMER')} THEN 'not_customer' END AS rule, "
    f"CASE WHEN NOT {_role('b.customer_id', 'CUSTOMER')} THEN {_lacks('b.customer_id', 'CUSTOMER')} END AS message "
    "FROM bookings b", "bookings", "user_roles")
ORACLES["accepted_bookings"] = _sql(
    "SELECT * FROM bookings WHERE customer_id IN (SELECT user_id FROM user_roles WHERE role = 'CUSTOMER')", "bookings", "user_roles")
ORACLES["check_orders"] = _sql(
    f"WITH c AS (SELECT o.*, {_role('o.waiter_id', 'WAITER')} AS w, {_role('o.customer_id', 'CUSTOMER')} AS c FROM ords o) "
    "SELECT order_id, customer_id, waiter_id, table_id, CASE WHEN NOT w THEN 'not_waiter' WHEN NOT c THEN 'not_customer' "
    "WHEN customer_id = waiter_id THEN 'same_person' END AS rule, "
    f"CASE WHEN NOT w THEN {_lacks('waiter_id', 'WAITER')} WHEN NOT c THEN {_lacks('customer_id', 'CUSTOMER')} "
    "WHEN customer_id = waiter_id THEN concat('user ', waiter_id, ' would wait on themselves') END AS message FROM c",
    "ords", "user_roles")
ORACLES["check_specialties"] = _sql(
    f"SELECT e.*, CASE WHEN NOT {_role('e.cook_id', 'COOK')} THEN 'not_cook' END AS rule, "
    f"CASE WHEN NOT {_role('e.cook_id', 'COOK')} THEN {_lacks('e.cook_id', 'COOK')} END AS message FROM specialties e",
    "specialties", "user_roles")
ORACLES["check_preparations"] = _sql(
    "WITH p AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE WHEN l_linenumber % 2 = 0 "
    "THEN l_suppkey - l_suppkey % 10 + 3 ELSE l_suppkey END AS cook_id, l_partkey AS dish_id FROM lineitem), "
    f"c AS (SELECT p.*, {_role('p.cook_id', 'COOK')} AS cook, EXISTS (SELECT 1 FROM specialties e "
    "WHERE e.cook_id = p.cook_id AND e.dish_id = p.dish_id) AS knows FROM p) "
    "SELECT order_id, line_no, cook_id, dish_id, CASE WHEN NOT cook THEN 'not_cook' WHEN NOT knows THEN 'no_specialty' "
    f"END AS rule, CASE WHEN NOT cook THEN {_lacks('cook_id', 'COOK')} WHEN NOT knows THEN "
    "concat('dish ', dish_id, ' is beyond the specialties of cook ', cook_id) END AS message FROM c",
    "specialties", "user_roles")
ORACLES["check_preparations_by_line"] = _sql(
    "WITH p AS (SELECT line_id, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey - l_suppkey % 10 + 3 ELSE l_suppkey END "
    f"AS cook_id, l_partkey AS dish_id FROM numbered), c AS (SELECT p.*, {_role('p.cook_id', 'COOK')} AS cook, EXISTS ("
    "SELECT 1 FROM specialties e WHERE e.cook_id = p.cook_id AND e.dish_id = p.dish_id) AS knows FROM p) "
    "SELECT line_id, cook_id, CASE WHEN NOT cook THEN 'not_cook' WHEN NOT knows THEN 'no_specialty' END AS rule, "
    f"CASE WHEN NOT cook THEN {_lacks('cook_id', 'COOK')} WHEN NOT knows THEN concat('line ', line_id, "
    "' is beyond the specialties of cook ', cook_id) END AS message FROM c", "numbered", "specialties", "user_roles")

_SLOT_RULES = (
    "SELECT slot_id, table_id, booking_id, start, duration_s, CASE WHEN party_size IS NULL THEN 'booking_missing' "
    "WHEN seats IS NULL THEN 'table_missing' WHEN party_size > seats THEN 'party_too_big' "
    "WHEN cross_n > 0 THEN 'table_overlap' WHEN slot_n > 0 THEN 'booking_has_slot' "
    "WHEN people + party_size > cap THEN 'over_capacity' "
    "WHEN NOT coalesce(duration_s BETWEEN 1 AND 7200 AND start IS NOT NULL, false) THEN 'slot_invalid' END AS rule, "
    "CASE WHEN party_size IS NULL THEN concat('no booking ', booking_id, ' is known') "
    "WHEN seats IS NULL THEN concat('no table ', table_id, ' is known') "
    "WHEN party_size > seats THEN concat('a party of ', party_size, ' is more than the ', seats, ' seats of table ', table_id) "
    "WHEN cross_n > 0 THEN concat('table ', table_id, ' is taken for part of that time') "
    "WHEN slot_n > 0 THEN concat('booking ', booking_id, ' has its slot') "
    "WHEN people + party_size > cap THEN concat(people, ' people and ', party_size, ' more are too many for ', cap, ' seats') "
    "WHEN NOT coalesce(duration_s BETWEEN 1 AND 7200 AND start IS NOT NULL, false) "
    "THEN 'a slot starts at some time and lasts up to 2 hours' END AS message FROM j")


def _slot_check(candidates: str, not_self: str) -> str:
    return _sql(
        f"WITH cand AS ({candidates}), "
        "people AS (SELECT c.slot_id, CAST(coalesce(sum(b.party_size), 0) AS BIGINT) AS people FROM cand c "
        f"LEFT JOIN booked b ON b.status IN (1, 2) AND b.start < c.finish AND c.start < b.finish AND c.start < c.finish {not_self} GROUP BY 1), "
        "crossed AS (SELECT c.slot_id, count(b.slot_id) AS cross_n FROM cand c LEFT JOIN booked b "
        f"ON b.table_id = c.table_id AND b.status <> 4 AND b.start < c.finish AND c.start < b.finish AND c.start < c.finish {not_self} GROUP BY 1), "
        "taken AS (SELECT c.slot_id, count(b.slot_id) AS slot_n FROM cand c LEFT JOIN slots b "
        f"ON b.booking_id = c.booking_id {not_self} GROUP BY 1), "
        "j AS (SELECT c.*, b.party_size, t.seats, cross_n, slot_n, people, "
        "(SELECT CAST(sum(seats) AS BIGINT) FROM dining_tables) AS cap FROM cand c JOIN people USING (slot_id) "
        "JOIN crossed USING (slot_id) JOIN taken USING (slot_id) LEFT JOIN bookings b ON b.booking_id = c.booking_id "
        "LEFT JOIN dining_tables t ON t.table_id = c.table_id) " + _SLOT_RULES,
        "booked", "dining_tables")


ORACLES["check_slots"] = _slot_check(
    "SELECT event_id + 1000000000 AS slot_id, (user_id * 7 + k) % ((SELECT n FROM n) + 1) AS table_id, "
    "event_id * 2 AS booking_id, ts + to_seconds(1800) AS start, 1800 * (k % 6) AS duration_s, "
    "ts + to_seconds(1800 + 1800 * (k % 6)) AS finish FROM ev", "")
ORACLES["recheck_slots"] = _slot_check("SELECT * FROM slots", "AND b.slot_id <> c.slot_id")
ORACLES["check_columns"] = _sql(
    "SELECT slot_id, table_id, booking_id, start, 1800 * (slot_id % 6) AS duration_s, CASE WHEN 1800 * (slot_id % 6) "
    "NOT BETWEEN 1 AND 7200 THEN 'duration_s_invalid' END AS rule, CASE WHEN 1800 * (slot_id % 6) NOT BETWEEN 1 AND 7200 "
    "THEN 'duration must be positive and at most 2 hours' END AS message FROM slots", "slots")


def _fk(child: str, column: str, parent: str, key: str, label: str | None = None) -> str:
    name = label or f"{child}.{column}"
    return (
        f"SELECT '{name}' AS fk, count(*) AS n_rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {parent} p "
        f"WHERE p.{key} = c.{column})) AS n_orphans FROM {child} c WHERE c.{column} IS NOT NULL")


ORACLES["audit_fks"] = _sql(
    " UNION ALL ".join([
        _fk("role_assignments", "role_id", "roles", "role_id"), _fk("role_assignments", "user_id", "users", "user_id"),
        _fk("dishes", "category_id", "categories", "category_id"), _fk("bookings", "customer_id", "users", "user_id"),
        _fk("slots", "table_id", "dining_tables", "table_id"), _fk("slots", "booking_id", "bookings", "booking_id"),
        _fk("ords", "customer_id", "users", "user_id", "orders.customer_id"),
        _fk("ords", "waiter_id", "users", "user_id", "orders.waiter_id"),
        _fk("ords", "table_id", "dining_tables", "table_id", "orders.table_id"),
        _fk("order_lines", "dish_id", "dishes", "dish_id"), _fk("order_lines", "order_id", "ords", "order_id"),
        _fk("specialties", "cook_id", "users", "user_id"), _fk("specialties", "dish_id", "dishes", "dish_id"),
        _fk("preparations", "cook_id", "users", "user_id"), _fk("preparations", "line_id", "numbered", "line_id"),
    ]),
    "user_roles", "users", "dining_tables", "booked", "ords", "order_lines", "dishes", "specialties", "preparations")


def _dup(table: str, key: str, label: str) -> str:
    return (
        f"SELECT '{label}({key})' AS \"constraint\", concat_ws(',', {key}) AS key, count(*) AS n FROM {table} "
        f"WHERE concat({key}) IS NOT NULL GROUP BY {key} HAVING count(*) > 1")


ORACLES["audit_uniques"] = _sql(
    " UNION ALL ".join([
        _dup("roles", "role_id", "roles"), _dup("roles", "name", "roles"),
        _dup("users", "user_id", "users"), _dup("users", "login", "users"),
        _dup("role_assignments", "role_id,user_id", "role_assignments"), _dup("dining_tables", "table_id", "dining_tables"),
        _dup("categories", "category_id", "categories"), _dup("categories", "name", "categories"),
        _dup("dishes", "dish_id", "dishes"), _dup("dishes", "name", "dishes"), _dup("bookings", "booking_id", "bookings"),
        _dup("slots", "slot_id,start", "slots"), _dup("ords", "order_id", "orders"), _dup("numbered", "line_id", "order_lines"),
        _dup("specialties", "cook_id,dish_id", "specialties"), _dup("preparations", "cook_id,line_id", "preparations"),
    ]), "roles", "users", "role_assignments", "dining_tables", "dishes", "bookings", "ords", "slots", "specialties", "preparations")
ORACLES["audit_columns"] = _sql(
    "SELECT 'slots' AS table_name, 'duration_s_invalid' AS rule, count(*) AS n FROM slots "
    "WHERE 1800 * (slot_id % 6) NOT BETWEEN 1 AND 7200 UNION ALL "
    "SELECT 'orders', 'customer_id_invalid', count(*) FROM ords WHERE customer_id = waiter_id HAVING count(*) > 0", "slots", "ords")
ORACLES["audit_overlaps"] = _sql(
    "SELECT 'overlap' AS kind, a.table_id, a.slot_id, count(*) AS n_overlaps FROM booked a JOIN booked b "
    "ON a.table_id = b.table_id AND a.slot_id <> b.slot_id AND a.start < b.finish AND b.start < a.finish "
    "WHERE a.status <> 4 AND b.status <> 4 GROUP BY ALL UNION ALL "
    "SELECT 'party_too_big', b.table_id, b.slot_id, NULL FROM booked b JOIN dining_tables t USING (table_id) "
    "WHERE b.party_size > t.seats", "booked", "dining_tables")
ORACLES["audit_overlap_counts"] = _sql(
    "SELECT a.table_id, a.slot_id, count(*) AS n_overlaps FROM booked a JOIN booked b "
    "ON a.table_id = b.table_id AND a.slot_id <> b.slot_id AND a.start < b.finish AND b.start < a.finish "
    "WHERE a.status <> 4 AND b.status <> 4 GROUP BY ALL", "booked")
ORACLES["audit_capacity"] = _sql(
    "SELECT a.slot_id, a.table_id, CAST(sum(b.party_size) AS BIGINT) AS people_booked, "
    "(SELECT CAST(sum(seats) // 5 AS BIGINT) FROM dining_tables) AS total_seats FROM booked a JOIN booked b "
    "ON a.start < b.finish AND b.start < a.finish WHERE a.status IN (1, 2) AND b.status IN (1, 2) GROUP BY 1, 2 "
    "HAVING sum(b.party_size) > (SELECT sum(seats) // 5 FROM dining_tables)", "booked", "dining_tables")
ORACLES["audit_repeated_bookings"] = _sql(
    "SELECT booking_id, count(*) AS n_slots FROM (SELECT booking_id FROM slots UNION ALL SELECT event_id * 2 FROM ev) "
    "GROUP BY booking_id HAVING count(*) > 1", "slots")
ORACLES["admit_slots"] = _sql(
    "WITH cand AS (SELECT b.*, t.seats, CAST(round(e.value * 100) AS BIGINT) AS arrived FROM booked b "
    "JOIN events e ON e.event_id = b.slot_id LEFT JOIN dining_tables t USING (table_id) WHERE b.status <> 2), "
    "pre AS (SELECT c.*, CASE WHEN party_size > seats THEN 'party_too_big' WHEN EXISTS (SELECT 1 FROM booked x "
    "WHERE x.status = 2 AND x.table_id = c.table_id AND x.start < c.finish AND c.start < x.finish) "
    "THEN 'table_overlap' END AS pre_rule FROM cand c), "
    "line AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY arrived, slot_id) AS rn FROM pre "
    "WHERE pre_rule IS NULL), "
    "walk AS (SELECT DISTINCT table_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS slot_id, false AS ok, "
    "CAST([] AS STRUCT(s TIMESTAMP, e TIMESTAMP)[]) AS taken FROM line UNION ALL "
    "SELECT w.table_id, l.rn, l.slot_id, len(list_filter(w.taken, lambda x: x.s < l.finish AND l.start < x.e)) = 0, "
    "CASE WHEN l.status <> 4 AND len(list_filter(w.taken, lambda x: x.s < l.finish AND l.start < x.e)) = 0 "
    "THEN list_append(w.taken, {'s': l.start, 'e': l.finish}) ELSE w.taken END "
    "FROM walk w JOIN line l ON l.table_id = w.table_id AND l.rn = w.rn + 1), "
    "judged AS (SELECT p.*, CASE WHEN pre_rule IS NOT NULL THEN pre_rule WHEN NOT w.ok THEN 'table_overlap' END AS rule "
    "FROM pre p LEFT JOIN walk w ON w.slot_id = p.slot_id) "
    "SELECT slot_id, table_id, booking_id, rule, CASE rule WHEN 'party_too_big' THEN concat('a party of ', party_size, "
    "' is more than the ', seats, ' seats of table ', table_id) WHEN 'table_overlap' THEN concat('table ', table_id, "
    "' is taken for part of that time') END AS message FROM judged", "booked", "dining_tables", recursive=True)

# One walk over the whole batch: each step joins one candidate to all that were admitted before.
ORACLES["admit_slots_capacity"] = _sql(
    "WITH cand AS (SELECT b.*, t.seats, row_number() OVER (ORDER BY CAST(round(e.value * 100) AS BIGINT), b.slot_id) AS rn "
    "FROM booked b JOIN events e ON e.event_id = b.slot_id LEFT JOIN dining_tables t USING (table_id) WHERE b.status <> 2), "
    "fifth AS (SELECT CAST(floor(sum(seats) / 5) AS BIGINT) AS n FROM dining_tables), "
    "pre AS MATERIALIZED (SELECT c.rn, c.table_id AS t, c.start AS s, c.finish AS e, c.party_size AS p, c.status, "
    "CASE WHEN c.party_size > c.seats THEN 'party_too_big' WHEN count(x.slot_id) FILTER (x.table_id = c.table_id) > 0 "
    "THEN 'table_overlap' END AS rule, CAST(coalesce(sum(x.party_size), 0) AS BIGINT) AS stored FROM cand c LEFT JOIN "
    "(FROM booked WHERE status = 2) x ON x.start < c.finish AND c.start < x.finish "
    "GROUP BY c.rn, c.table_id, c.start, c.finish, c.party_size, c.status, c.seats), "
    "walk(rn, t, s, e, p, b, rule, taken) USING KEY (rn) AS ("
    "SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT), "
    "false, 'start', CAST(0 AS BIGINT) UNION ALL "
    "SELECT rn, t, s, e, if(status IN (1, 2), p, 0), status <> 4, CASE WHEN pre_rule IS NOT NULL THEN pre_rule "
    "WHEN crossing > 0 THEN 'table_overlap' WHEN stored + beside + p > (SELECT n FROM fifth) THEN 'over_capacity' END, "
    "stored + beside FROM ("
    "SELECT c.rn, any_value(c.t) AS t, any_value(c.s) AS s, any_value(c.e) AS e, any_value(c.p) AS p, "
    "any_value(c.status) AS status, any_value(c.rule) AS pre_rule, any_value(c.stored) AS stored, "
    "count(a.rn) FILTER (a.t = c.t AND a.b) AS crossing, CAST(coalesce(sum(a.p), 0) AS BIGINT) AS beside "
    "FROM walk w JOIN pre c ON c.rn = w.rn + 1 "
    "LEFT JOIN recurring.walk a ON a.rule IS NULL AND a.s < c.e AND c.s < a.e GROUP BY c.rn)) "
    "SELECT slot_id, table_id, booking_id, w.rule, CASE w.rule WHEN 'party_too_big' THEN concat('a party of ', party_size, "
    "' is more than the ', seats, ' seats of table ', table_id) WHEN 'table_overlap' THEN concat('table ', table_id, "
    "' is taken for part of that time') WHEN 'over_capacity' THEN concat(taken, ' people and ', party_size, "
    "' more are too many for ', (SELECT n FROM fifth), ' seats') END AS message FROM cand JOIN walk w USING (rn)",
    "booked", "dining_tables", recursive=True)

ORACLES["assign_ids"] = (
    "SELECT o_orderkey, o_orderdate, (SELECT max(o_orderkey) FROM orders) + row_number() OVER "
    "(ORDER BY o_orderdate, o_orderkey) AS order_id FROM orders")
ORACLES["resolve_names"] = _sql(
    "SELECT p_partkey AS dish_id, c.category_id, CASE WHEN c.name IS NULL THEN 'unknown name' END AS reason FROM part "
    "LEFT JOIN categories c ON c.name = CASE WHEN p_size % 10 = 0 THEN p_name ELSE p_type END", "categories")
_HEADS = ("heads AS (SELECT form_id, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY form_id) AS order_id "
          "FROM (SELECT form_id FROM forms GROUP BY form_id HAVING max(qty) > 0))")
ORACLES["split_order_forms"] = _sql(
    f"WITH {_HEADS} SELECT (SELECT count(*) FROM lineitem) + row_number() OVER (ORDER BY h.order_id, f.i) AS line_id, "
    f"h.order_id, f.dish_id, f.qty, 1 AS status, {AS_OF} AS requested FROM forms f JOIN heads h USING (form_id) "
    "WHERE f.qty > 0", "forms")
ORACLES["order_form_tables"] = _sql(
    f"WITH seat AS (SELECT customer_id, table_id, row_number() OVER (PARTITION BY customer_id ORDER BY start DESC, slot_id DESC) AS r "
    f"FROM booked WHERE start <= {AS_OF} AND finish >= {AS_OF}) "
    "SELECT o_orderkey AS form_id, o_custkey AS customer_id, table_id FROM orders LEFT JOIN seat ON customer_id = o_custkey AND r = 1",
    "booked")
ORACLES["order_form_headers"] = _sql(
    f"WITH {_HEADS} SELECT DISTINCT f.form_id, f.customer_id, f.waiter_id, f.table_id, h.order_id FROM forms f "
    "LEFT JOIN heads h USING (form_id)", "forms")
_LATEST = (
    "latest AS (SELECT l_orderkey AS booking_id, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END AS status, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, "
    "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END DESC) AS r FROM lineitem)")
ORACLES["apply_updates"] = _sql(
    f"WITH {_LATEST} SELECT b.booking_id, b.customer_id, b.party_size, coalesce(l.status, b.status) AS status "
    "FROM bookings b LEFT JOIN latest l ON l.booking_id = b.booking_id AND l.r = 1", "bookings")
ORACLES["changed_rows"] = _sql(
    f"WITH {_LATEST} SELECT b.booking_id, b.customer_id, b.party_size, l.status FROM bookings b "
    "JOIN latest l ON l.booking_id = b.booking_id AND l.r = 1", "bookings")
ORACLES["apply_deletes"] = _sql(
    "SELECT 'bookings' AS table_name, booking_id AS id FROM bookings WHERE status = 4 UNION ALL "
    "SELECT 'slots', slot_id FROM booked WHERE status = 4", "booked")
ORACLES["table_changes"] = _sql(
    "SELECT table_id, CAST(CASE seats WHEN 2 THEN 3 ELSE seats END AS INTEGER) AS seats FROM dining_tables "
    "WHERE table_id IN (SELECT table_id FROM slots UNION SELECT table_id FROM ords)", "dining_tables", "slots", "ords")
ORACLES["refused_deletes"] = _sql(
    "WITH refs AS (SELECT DISTINCT customer_id AS user_id, 'bookings.customer_id' AS blocked_by FROM bookings UNION "
    "SELECT customer_id, 'orders.customer_id' FROM ords UNION SELECT waiter_id, 'orders.waiter_id' FROM ords UNION "
    "SELECT l_suppkey, 'preparations.cook_id' FROM lineitem) "
    "SELECT u.user_id, r.blocked_by FROM users u LEFT JOIN refs r USING (user_id)", "users", "bookings", "ords")
ORACLES["model_scan"] = _sql(
    "SELECT u.user_id, u.login, CAST(sum(b.party_size) AS BIGINT) AS people FROM bookings b "
    "JOIN users u ON u.user_id = b.customer_id GROUP BY ALL", "bookings", "users")
ORACLES["append_defaults"] = _sql(
    "SELECT booking_id, customer_id, party_size, CASE status WHEN 4 THEN 4 ELSE 1 END AS status FROM bookings", "bookings")
ORACLES["slots_by_month_pruned"] = _sql(
    "WITH s AS (SELECT slot_id, table_id, booking_id, start + to_days(CAST(31 * (slot_id % 3) AS INTEGER)) AS start, "
    "duration_s FROM slots) SELECT * FROM s WHERE start < TIMESTAMP '2024-02-20' "
    "AND start + to_seconds(duration_s) > TIMESTAMP '2024-02-05'", "slots")

ORACLES["slots_by_place_pruned"] = _sql(
    "WITH s AS (SELECT slot_id, table_id, booking_id, start + to_days(CAST(31 * (slot_id % 3) AS INTEGER)) AS start, "
    "duration_s FROM slots) SELECT s.* FROM s, n WHERE start < TIMESTAMP '2024-02-07' "
    "AND start + to_seconds(duration_s) > TIMESTAMP '2024-02-05' AND table_id BETWEEN n // 4 AND 2 * (n // 4) - 1", "slots")
ORACLES["stored_slot_changes"] = _sql(
    "SELECT slot_id, table_id, booking_id, start + to_days(CAST(31 * (slot_id % 3) AS INTEGER)) "
    "+ CASE WHEN status = 4 THEN to_days(31) + to_hours(1) ELSE to_days(0) END AS start, duration_s "
    "FROM booked WHERE status <> 3", "booked")
ORACLES["append_batches"] = ORACLES["append_defaults"].replace("CASE status WHEN 4 THEN 4 ELSE 1 END AS status", "status")

ORACLES["stream_ready_alerts"] = _sql(
    _READY.format(line="", extra=", concat('Order ', l.order_id, ' waits at the pass for ', w.name) "
                                 "AS message"), "order_lines", "ords", "users", "dishes")
ORACLES["stream_upcoming_alerts"] = ORACLES["upcoming_bookings"]
ORACLES["stream_table_board"] = _board(
    "(SELECT max(ts) FROM events)", ", (SELECT max(ts) FROM events) AS at")
_LAST = "(SELECT greatest((SELECT max(ts) FROM events), (SELECT max(placed) FROM floor_orders)))"
ORACLES["stream_floor_board"] = _board(_LAST, f", {_LAST} AS at")
ORACLES["stream_live_board"] = _sql(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY start DESC, slot_id DESC) AS r FROM slots) "
    "SELECT table_id, start, slot_id, booking_id, duration_s FROM r WHERE r = 1", "slots")
ORACLES["stream_upcoming_once"] = _sql(
    "SELECT DISTINCT b.booking_id, u.name AS customer, b.table_id, b.start, b.finish AS \"end\" FROM booked b "
    "JOIN users u ON u.user_id = b.customer_id JOIN hours h ON b.start >= h.at AND b.start <= h.at + to_seconds(7200) "
    "WHERE b.status = 1", "booked", "users", "hours")
ORACLES["stream_daily_sales"] = _sql(
    "SELECT CAST(l.requested AS DATE) AS day, CAST(sum(l.qty * d.price) AS DECIMAL(38,2)) AS total_sales, "
    "count(*) AS n_lines FROM order_lines l JOIN dishes d USING (dish_id) WHERE l.status = 3 GROUP BY 1",
    "order_lines", "dishes")
ORACLES["stream_day_parts"] = ORACLES["stream_daily_sales"]
# Closed: the latest line is a day past the end of the day.
ORACLES["stream_closed_days"] = _sql(
    "SELECT CAST(l.requested AS DATE) AS day, CAST(sum(l.qty * d.price) AS DECIMAL(38,2)) AS total_sales, "
    "count(*) AS n_lines FROM order_lines l JOIN dishes d USING (dish_id) WHERE l.status = 3 GROUP BY 1 HAVING "
    "CAST(l.requested AS DATE) + 2 <= (SELECT max(requested) FROM order_lines WHERE status = 3)", "order_lines", "dishes")

