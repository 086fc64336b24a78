"""The roles in DuckDB SQL, as common table expressions for the comparison queries."""

from __future__ import annotations

_PARTS = {
    "oe": "SELECT o_orderkey, ((year(o_orderdate) * 100 + month(o_orderdate)) * 10 + r_regionkey)::BIGINT AS event_id, date_trunc('month', o_orderdate)::DATE AS event_date, r_regionkey, r_name, o_orderpriority AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "ev": "SELECT DISTINCT event_id, event_date, CASE WHEN r_regionkey % 2 = 0 THEN strftime(event_date, '%d/%m/%Y') ELSE strftime(event_date, '%Y-%m-%d') END AS date_text, 'Fair ' || r_name AS event_name, 'Square ' || r_name AS place, r_name AS city FROM oe",
    "grp": "SELECT n_nationkey::BIGINT AS group_id, n_name AS group_name FROM nation",
    "att": "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || l_linestatus AS attempt_id, event_id, s_nationkey::BIGINT AS group_id, CASE l_linenumber % 4 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN 'P' || l_partkey WHEN 2 THEN l_partkey || 'de' ELSE 'X' || l_partkey END AS item_name, CASE WHEN l_returnflag = 'A' THEN 'Descarregat' WHEN l_returnflag = 'R' THEN 'Carregat' WHEN l_linestatus = 'O' THEN 'Intent' ELSE 'Intent desmuntat' END AS status, day FROM lineitem JOIN oe ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey",
    "sc": "SELECT p_partkey::VARCHAR AS code, 'P' || p_partkey AS external, p_partkey || 'de' AS name, floor(p_retailprice)::BIGINT AS \"full\", floor(p_retailprice)::BIGINT - 100 AS partial, p_type AS tier FROM part",
    "perf": "SELECT att.*, ev.event_date, date_text, event_name, place, city, group_name, code AS item_code, \"full\", partial, tier, year(ev.event_date)::INTEGER AS event_year, coalesce(CASE status WHEN 'Descarregat' THEN \"full\" WHEN 'Carregat' THEN partial ELSE 0 END, 0)::BIGINT AS points, CASE WHEN regexp_matches(item_name, '^[0-9]') THEN 'castell' WHEN regexp_matches(item_name, '^[Pp]') THEN 'pilar' ELSE 'altres' END AS item_class FROM att JOIN ev USING (event_id) JOIN grp USING (group_id) LEFT JOIN (SELECT code AS alias, * FROM sc UNION ALL SELECT external, * FROM sc UNION ALL SELECT name, * FROM sc) x ON item_name = alias",
    "counted": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, group_id, item_class ORDER BY points DESC, attempt_id) AS rn FROM perf WHERE item_class <> 'altres') WHERE (item_class = 'castell' AND rn <= 3) OR rn = 1",
    "totals": "SELECT event_id, group_id, event_name, event_date, place, city, group_name, string_agg(item_name || ' (' || status || ')', ', ' ORDER BY points DESC, attempt_id) AS items_done, sum(points)::BIGINT AS total_points, count(*) AS num_items FROM counted GROUP BY ALL",
    "ranges": "SELECT group_name, min(y) AS min_year, max(y) AS max_year, CASE WHEN min(y) = max(y) THEN min(y)::VARCHAR ELSE min(y) || ' - ' || max(y) END AS year_range, count(*) AS num_years, sum(n)::BIGINT AS total_events FROM (SELECT group_id, regexp_extract(date_text, '([0-9]{4})', 1)::INTEGER AS y, count(DISTINCT event_id) AS n FROM att JOIN ev USING (event_id) GROUP BY ALL HAVING n > 10) JOIN grp USING (group_id) GROUP BY group_name",
}
_NEEDS = {"ev": ["oe"], "att": ["oe"], "perf": ["att", "ev", "grp", "sc"], "counted": ["perf"], "totals": ["counted"], "ranges": ["att", "ev", "grp"]}


def roles(*names: str, **more: str) -> str:
    """WITH the named roles and what they need, and further expressions by name."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join([f"{n} AS ({_PARTS[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]) + " "
