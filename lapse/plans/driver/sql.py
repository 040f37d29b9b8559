"""Shared pieces of the SQL texts. Times are handled as epoch microseconds."""

DAY = 86400000000

MARKET = f"""
items AS (
  SELECT l_orderkey, count(*) AS item_count, min(l_shipdate) AS first_ship,
         arg_min(l_partkey, l_linenumber::BIGINT * 10000000000 + l_partkey) AS product_id
  FROM lineitem GROUP BY l_orderkey),
market AS (
  SELECT o_custkey AS customer_id, epoch_us(o_orderdate) AS t, o_totalprice AS value,
         o_orderpriority AS payment_type, product_id,
         coalesce(least(item_count, 5), 0)::DOUBLE AS review_score,
         coalesce(floor((epoch_us(first_ship) - epoch_us(o_orderdate)) / {DAY}.0), 0)::DOUBLE AS delay
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey)"""

CLICK = """
click AS (
  SELECT user_id AS customer_id, epoch_us(ts) AS t, event_id AS product_id,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'cart_add'
              WHEN 'signup' THEN 'wishlist' WHEN 'purchase' THEN 'purchase' ELSE 'other' END AS kind,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS value,
         json_extract_string(props, '$.k') AS session_id,
         CASE event_type WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0
              ELSE 0.0 END::DOUBLE AS signal
  FROM events)"""


def cutoffs(source: str, window: float, name: str = "cut") -> str:
    """Global cutoffs of a relation with epoch microseconds in ``t``."""
    w = int(window * DAY)
    return f"""
{name}_raw AS (
  SELECT max(t) - {w} AS test_us, round(quantile_cont(t, 0.7))::BIGINT AS q_us, max(t) AS last_us
  FROM {source}),
{name} AS (
  SELECT CASE WHEN q_us >= test_us THEN test_us - {w} ELSE q_us END AS train_us, test_us, last_us
  FROM {name}_raw)"""


def points(cut: str = "cut", name: str = "points") -> str:
    return f"""
{name} AS (
  SELECT 'train' AS point, train_us AS s FROM {cut}
  UNION ALL SELECT 'test', test_us FROM {cut})"""


def labels(source: str, window: float, pts: str = "points", name: str = "labelled") -> str:
    """Inactivity labels of every point."""
    w = int(window * DAY)
    return f"""
{name} AS (
  SELECT point, customer_id,
         CASE WHEN bool_or(t > s AND t <= s + {w}) THEN 0 ELSE 1 END AS lapsed
  FROM {source} CROSS JOIN {pts} WHERE customer_id IS NOT NULL
  GROUP BY point, customer_id HAVING min(t) < any_value(s))"""


SCORES = """
scores AS (
  SELECT 'length' AS model, l.doc_id AS customer_id, l.toxic AS y, l.quality,
         least(1.0::DOUBLE, d.n_chars / 20000.0::DOUBLE) AS p, d.n_chars
  FROM labels l JOIN documents d USING (doc_id)),
pred AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM scores)"""

NUMBERED = f"""
numbered AS (
  SELECT o_custkey AS customer_id, o_orderkey AS order_id, epoch_us(o_orderdate) AS t,
         o_totalprice AS value,
         row_number() OVER w AS order_number,
         floor((epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER w) / {DAY}.0) AS gap
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def stable_hash(id_expr: str, tail: str) -> str:
    return f"('0x' || substr(md5({id_expr}::VARCHAR || '|{tail}'), 1, 15))::BIGINT"
