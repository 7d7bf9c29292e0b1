"""The auction benchmark's questions, over the test tables in the roles of its streams.

Persons are customers, auctions are orders (open for 60 days), bids are line items. The same view texts define the roles in both engines.
"""

from __future__ import annotations

from freshet.workload.base import Registry, dialect

R = Registry()

PERSON = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, n_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey"
AUCTION = "SELECT o_orderkey AS id, o_custkey AS seller, o_orderdate AS date_time, o_orderdate + INTERVAL '60' DAY AS expires, o_orderkey % 5 + 10 AS category, o_orderpriority AS item FROM orders"
BID = "SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_returnflag AS channel, concat('https://example.com/a/', l_linestatus, '/i?channel_id=', l_linenumber) AS url, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS date_time FROM lineitem"
_ROLES = f"WITH person AS ({PERSON}), auction AS ({AUCTION}), bid AS ({BID}) "


def _put(name: str, ours: str, duck: str = "") -> None:
    R.queries[f"nexmark_{name}"] = dialect(_ROLES + ours)
    R.oracles[f"nexmark_{name}"] = _ROLES + (duck or ours)


_put("q0", "SELECT auction, bidder, price, date_time FROM bid")
_put("q1", "SELECT auction, bidder, round(price * 0.908D, 2) AS price, date_time FROM bid", "SELECT auction, bidder, round(price * 0.908::DOUBLE, 2) AS price, date_time FROM bid")
_put("q2", "SELECT auction, price FROM bid WHERE MOD(auction, 123) = 0")
_put("q3", "SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN ('NATION_1', 'NATION_2', 'NATION_3')")
_WON = "SELECT a.id, a.category, MAX(b.price) AS final FROM auction a JOIN bid b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires GROUP BY a.id, a.category"
_put("q4", f"SELECT category, AVG(final) AS price FROM ({_WON}) AS w GROUP BY category", f"SELECT category, CAST(trunc(AVG(final)) AS BIGINT) AS price FROM ({_WON}) AS w GROUP BY category")
_HOP = "SELECT auction, window_start, window_end, COUNT(*) AS num FROM TABLE(HOP(TABLE bid, DESCRIPTOR(date_time), INTERVAL '10' DAY, INTERVAL '30' DAY)) GROUP BY auction, window_start, window_end"
_HOP_DUCK = "SELECT auction, s AS window_start, COUNT(*) AS num FROM (SELECT auction, time_bucket(INTERVAL 10 DAY, date_time, TIMESTAMP '1970-01-01') - INTERVAL 10 DAY * unnest([0, 1, 2]) AS s FROM bid) GROUP BY ALL"
_put("q5", f"SELECT auction, num, window_start FROM ({_HOP}) AS h QUALIFY RANK() OVER (PARTITION BY window_start ORDER BY num DESC) = 1", f"SELECT auction, num, window_start FROM ({_HOP_DUCK}) AS h QUALIFY RANK() OVER (PARTITION BY window_start ORDER BY num DESC) = 1")
_LAST = "AVG(final) OVER (PARTITION BY seller ORDER BY id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
_SOLD = f"(SELECT a.seller, w.id, w.final FROM ({_WON}) AS w JOIN auction a ON a.id = w.id) AS x"
_put("q6", f"SELECT seller, id, {_LAST} AS price FROM {_SOLD}", f"SELECT seller, id, CAST(trunc({_LAST}) AS BIGINT) AS price FROM {_SOLD}")
_put("q7", "SELECT b.auction, b.price, b.bidder, b.date_time FROM bid b JOIN (SELECT MAX(price) AS top, TUMBLE_START(date_time, INTERVAL '10' DAY) AS s FROM bid GROUP BY TUMBLE(date_time, INTERVAL '10' DAY)) AS m ON b.price = m.top AND b.date_time >= m.s AND b.date_time < m.s + INTERVAL '10' DAY", "SELECT auction, price, bidder, date_time FROM bid QUALIFY RANK() OVER (PARTITION BY time_bucket(INTERVAL 10 DAY, date_time, TIMESTAMP '1970-01-01') ORDER BY price DESC) = 1")
_put("q8", "SELECT DISTINCT p.id, p.name, s.starttime FROM person p JOIN (SELECT seller, TUMBLE_START(date_time, INTERVAL '10' DAY) AS starttime FROM auction GROUP BY seller, TUMBLE(date_time, INTERVAL '10' DAY)) AS s ON p.id = s.seller", "SELECT DISTINCT p.id, p.name, time_bucket(INTERVAL 10 DAY, a.date_time, TIMESTAMP '1970-01-01') AS starttime FROM person p JOIN auction a ON p.id = a.seller")
_put("q9", "SELECT a.id, a.seller, b.bidder, b.price, b.date_time AS bid_time FROM auction a JOIN bid b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time, b.seq) = 1")
_put("q10", "SELECT auction, bidder, price, FORMAT_TIMESTAMP('%Y-%m-%d', date_time) AS dt, FORMAT_TIMESTAMP('%H:%M', date_time) AS hm FROM bid", "SELECT auction, bidder, price, strftime(date_time, '%Y-%m-%d') AS dt, strftime(date_time, '%H:%M') AS hm FROM bid")
_put("q11", "SELECT bidder, window_start, window_end, COUNT(*) AS n FROM TABLE(SESSION(TABLE bid, DESCRIPTOR(date_time), DESCRIPTOR(bidder), INTERVAL '3' DAY)) GROUP BY bidder, window_start, window_end", "SELECT bidder, MIN(date_time) AS window_start, MAX(date_time) + INTERVAL 3 DAY AS window_end, COUNT(*) AS n FROM (SELECT *, SUM(f) OVER (PARTITION BY bidder ORDER BY date_time) AS s FROM (SELECT *, CASE WHEN date_time < lag(date_time) OVER (PARTITION BY bidder ORDER BY date_time) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS f FROM bid)) GROUP BY bidder, s")
_put("q12", "SELECT bidder, COUNT(*) AS bid_count, TUMBLE_START(date_time, INTERVAL '10' DAY) AS starttime FROM bid GROUP BY bidder, TUMBLE(date_time, INTERVAL '10' DAY)", "SELECT bidder, COUNT(*) AS bid_count, time_bucket(INTERVAL 10 DAY, date_time, TIMESTAMP '1970-01-01') AS starttime FROM bid GROUP BY ALL")
_put("q13", "SELECT b.auction, b.bidder, b.price, s.value FROM (SELECT *, MOD(auction, 100) AS m FROM bid) AS b LEFT ASOF JOIN (SELECT seller AS k, MAX(item) AS value, date_time AS t FROM auction GROUP BY seller, date_time) AS s MATCH_CONDITION b.date_time >= s.t ON b.m = s.k", "SELECT b.auction, b.bidder, b.price, s.value FROM (SELECT *, MOD(auction, 100) AS m FROM bid) AS b ASOF LEFT JOIN (SELECT seller AS k, MAX(item) AS value, date_time AS t FROM auction GROUP BY seller, date_time) AS s ON b.m = s.k AND b.date_time >= s.t")
_put("q14", "SELECT auction, bidder, CASE WHEN DAYOFMONTH(date_time) BETWEEN 8 AND 18 THEN 'middle' WHEN DAYOFMONTH(date_time) <= 6 OR DAYOFMONTH(date_time) >= 20 THEN 'edge' ELSE 'other' END AS period, char_length(url) - char_length(replace(url, 'c', '')) AS c_counts FROM bid WHERE price > 1000000 AND price < 5000000", "SELECT auction, bidder, CASE WHEN DAYOFMONTH(date_time) BETWEEN 8 AND 18 THEN 'middle' WHEN DAYOFMONTH(date_time) <= 6 OR DAYOFMONTH(date_time) >= 20 THEN 'edge' ELSE 'other' END AS period, CAST(length(url) - length(replace(url, 'c', '')) AS INTEGER) AS c_counts FROM bid WHERE price > 1000000 AND price < 5000000")
_RANKS = ", ".join(f"COUNT({what}) FILTER (WHERE {cond}) AS rank{i}_{name}" for name, what in (("bids", "*"), ("bidders", "DISTINCT bidder"), ("auctions", "DISTINCT auction")) for i, cond in enumerate(("price < 1000000", "price >= 1000000 AND price < 5000000", "price >= 5000000"), 1))
_put("q15", f"SELECT CAST(date_time AS DATE) AS day, COUNT(*) AS total_bids, COUNT(DISTINCT bidder) AS total_bidders, COUNT(DISTINCT auction) AS total_auctions, {_RANKS} FROM bid GROUP BY CAST(date_time AS DATE)")
_put("q16", f"SELECT channel, CAST(date_time AS DATE) AS day, FORMAT_TIMESTAMP('%H:%M', MAX(date_time)) AS minute, COUNT(*) AS total_bids, {_RANKS} FROM bid GROUP BY channel, CAST(date_time AS DATE)", f"SELECT channel, CAST(date_time AS DATE) AS day, strftime(MAX(date_time), '%H:%M') AS minute, COUNT(*) AS total_bids, {_RANKS} FROM bid GROUP BY channel, CAST(date_time AS DATE)")
_put("q17", "SELECT auction, CAST(date_time AS DATE) AS day, COUNT(*) AS total_bids, COUNT(*) FILTER (WHERE price < 1000000) AS rank1_bids, MIN(price) AS min_price, MAX(price) AS max_price, AVG(price) AS avg_price, SUM(price) AS sum_price FROM bid GROUP BY auction, CAST(date_time AS DATE)", "SELECT auction, CAST(date_time AS DATE) AS day, COUNT(*) AS total_bids, COUNT(*) FILTER (WHERE price < 1000000) AS rank1_bids, MIN(price) AS min_price, MAX(price) AS max_price, CAST(trunc(AVG(price)) AS BIGINT) AS avg_price, CAST(SUM(price) AS BIGINT) AS sum_price FROM bid GROUP BY auction, CAST(date_time AS DATE)")
_put("q18", "SELECT auction, bidder, price, date_time FROM bid QUALIFY ROW_NUMBER() OVER (PARTITION BY bidder, auction ORDER BY date_time DESC, seq, price) <= 1")
_put("q19", "SELECT auction, bidder, price, rank_number FROM (SELECT auction, bidder, price, ROW_NUMBER() OVER (PARTITION BY auction ORDER BY price DESC, seq, bidder) AS rank_number FROM bid) AS t WHERE rank_number <= 10", "SELECT auction, bidder, price, rank_number FROM (SELECT auction, bidder, price, CAST(ROW_NUMBER() OVER (PARTITION BY auction ORDER BY price DESC, seq, bidder) AS INTEGER) AS rank_number FROM bid) AS t WHERE rank_number <= 10")
_put("q20", "SELECT b.auction, b.bidder, b.price, a.item, a.seller, a.category FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10")
_put("q21", "SELECT auction, bidder, price, CASE WHEN lower(channel) = 'a' THEN '0' WHEN lower(channel) = 'n' THEN '1' ELSE regexp_extract(url, '(&|^|[?])channel_id=([^&]*)', 2) END AS channel_id FROM bid")
_put("q22", "SELECT auction, bidder, price, SPLIT(url, '/')[4] AS dir1, SPLIT(url, '/')[5] AS dir2 FROM bid", "SELECT auction, bidder, price, string_split(url, '/')[4] AS dir1, string_split(url, '/')[5] AS dir2 FROM bid")
