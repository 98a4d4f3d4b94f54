"""The catalog's queries as plain SQL over the same test tables."""

from __future__ import annotations

from tiffin.functions import rules

_TABLES = """
WITH t_brand AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS ID, p_brand FROM part),
t_restaurant AS (
  SELECT ID, 'Brand ' || chr(CAST(64 + ID AS INT)) AS name,
         '09' || lpad(CAST(ID AS VARCHAR), 8, '0') AS phone_number FROM t_brand),
t_item AS (
  SELECT p_partkey AS ID, p_name AS name, CAST(round(p_retailprice * 100) AS INT) AS price, '' AS image,
         CAST(substr(p_brand, 7) AS BIGINT) * 10
         + list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) AS categoryID,
         p_type, p_size, p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS RID,
         'Brand ' || chr(CAST(64 + CAST(substr(p_brand, 7) AS BIGINT) AS INT)) AS rname
  FROM part),
t_category AS (SELECT DISTINCT categoryID AS ID, p_type AS name, RID FROM t_item),
t_customer AS (
  SELECT c_custkey + 1000 AS ID, c_name AS name, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.com' AS email,
         CAST(round(c_acctbal) AS BIGINT) AS exchange_points, '0' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone_number,
         'Nation ' || c_nationkey AS address, CAST(DATE '1980-01-01' + c_nationkey * 100 AS DATE) AS birthdate,
         lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS card_number, c_mktsegment AS bank_name
  FROM customer),
t_account AS (
  SELECT c_custkey + 1000 AS ID, c_name AS username, c_mktsegment || c_nationkey AS password FROM customer
  UNION ALL SELECT ID, p_brand, 'secret-' || p_brand FROM t_brand),
t_dfr AS (
  SELECT 'DIS_' || s_suppkey AS code, s_suppkey % 50 * 2 + 40 AS usageLimit, CAST(0 AS BIGINT) AS used_Count,
         CAST((s_suppkey % 100 + 1) * 50000 AS INT) AS value, s_suppkey % 20 + 1 AS RID
  FROM supplier),
t_order AS (
  SELECT o_orderkey AS ID, CASE WHEN o_orderkey % 2 = 0 THEN 'CARD' ELSE 'CASH' END AS Payment_method,
         'Lane ' || o_custkey AS address,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'confirmed' ELSE 'pending' END AS order_status,
         o_orderdate AS order_time_stamp, '' AS review,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 5 + 1 AS INT) END AS rating,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'delivering' END AS ship_status,
         CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'in_process' END AS get_status,
         CAST(o_orderkey % 3 * 500 + 1500 AS INT) AS delivery_fee, o_custkey + 1000 AS CID,
         o_orderkey % 25 + 1 AS RID, (o_custkey >> 4) + 1 AS FDID, o_totalprice, o_custkey, o_orderpriority
  FROM orders),
t_line_raw AS (
  SELECT l_orderkey AS FOID, l_partkey AS FIID, CAST(l_quantity AS INT) AS quantity FROM lineitem),
t_line AS (SELECT FOID, FIID, CAST(sum(quantity) AS INT) AS quantity FROM t_line_raw GROUP BY ALL),
t_apply AS (
  SELECT 'DIS_' || (o_custkey >> 4) AS DFRcode, o_orderkey AS FOID FROM orders),
t_apply_some AS (
  SELECT 'DIS_' || (o_custkey >> 4) AS DFRcode, o_orderkey AS FOID FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
t_use AS (
  SELECT DISTINCT o_custkey + 1000 AS CID, 'DIS_' || (o_custkey >> 4) AS DFRcode FROM orders),
t_points AS (
  SELECT 'EXC_' || o_orderkey AS code, CAST(o_custkey % 90 * 1000 + 10000 AS INT) AS value, o_custkey + 1000 AS CID,
         o_orderkey AS FOID FROM orders),
t_points_some AS (
  SELECT t_points.* FROM t_points JOIN orders ON FOID = o_orderkey
  WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')),
t_total AS (
  SELECT FOID, CAST(sum(CAST(price AS BIGINT) * quantity) AS BIGINT) AS total
  FROM t_line JOIN t_item ON FIID = t_item.ID GROUP BY FOID),
t_report AS (
  SELECT o.ID AS OrderID, Payment_method, address AS OrderAddress, order_status AS OrderStatus,
         order_time_stamp AS OrderTimestamp, review, rating, ship_status AS ShippingStatus,
         get_status AS GetStatus, delivery_fee, total AS TotalOrderPrice,
         CAST(coalesce(r.value, 0) AS BIGINT) AS RestaurantDiscount,
         CAST(coalesce(p.value, 0) AS BIGINT) AS ExchangePointDiscount,
         CAST(coalesce(r.value, 0) AS BIGINT) + CAST(coalesce(p.value, 0) AS BIGINT) AS TotalDiscount
  FROM t_order o LEFT JOIN t_total ON t_total.FOID = o.ID
  LEFT JOIN (SELECT FOID, value FROM t_apply_some JOIN t_dfr ON DFRcode = code) r ON r.FOID = o.ID
  LEFT JOIN t_points_some p ON p.FOID = o.ID
  WHERE r.FOID IS NOT NULL OR p.FOID IS NOT NULL),
t_by_category AS (
  SELECT categoryID, o.ID AS OrderID, order_time_stamp AS OrderTime, rating, c.name AS CustomerName,
         CAST(sum(quantity) AS BIGINT) AS TotalItems, order_status AS OrderStatus,
         CAST(sum(CAST(quantity AS BIGINT) * price) AS BIGINT) AS TotalRevenue
  FROM t_order o JOIN t_customer c ON o.CID = c.ID JOIN t_line l ON o.ID = l.FOID JOIN t_item i ON l.FIID = i.ID
  GROUP BY categoryID, o.ID, order_time_stamp, rating, c.name, order_status HAVING TotalItems > 0),
t_stats AS (
  SELECT rname, (2 * CAST(sum(price) AS BIGINT) + count(*)) // (2 * count(*)) AS avg_price,
         min(price) AS min_price, max(price) AS max_price, count(*) AS n FROM t_item GROUP BY rname),
t_level AS (
  SELECT rname, ID, name, price,
         CASE WHEN 2 * price >= avg_price + max_price THEN 'High'
              WHEN 2 * price <= avg_price + min_price THEN 'Low' ELSE 'Medium' END AS price_level
  FROM t_item JOIN t_stats USING (rname)),
t_app_request AS (
  SELECT DFRcode, FOID, FOID * 2 AS seq FROM t_apply
  UNION ALL
  SELECT CASE WHEN o_orderpriority = '2-HIGH' THEN 'DIS_' || (o_custkey >> 4) ELSE 'DIS_' || o_custkey END,
         o_orderkey, o_orderkey * 2 + 1 FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
t_app_judged AS (
  SELECT a.DFRcode, a.FOID, a.seq, d.code, usageLimit, used_Count,
         CASE WHEN CAST(d.value AS BIGINT) * 100 > total * 30
              THEN 'The discount exceeds 30% of the total food order price.' END AS cap
  FROM t_app_request a LEFT JOIN t_dfr d ON a.DFRcode = d.code LEFT JOIN t_total t ON t.FOID = a.FOID),
t_app_standing AS (
  SELECT DFRcode, FOID, min(seq) AS first_seq, any_value(used_Count) AS used, any_value(usageLimit) AS most
  FROM t_app_judged WHERE cap IS NULL AND code IS NOT NULL GROUP BY DFRcode, FOID),
t_app_place AS (
  SELECT *, used + row_number() OVER (PARTITION BY DFRcode ORDER BY first_seq) > most AS full_up FROM t_app_standing),
t_admission AS (
  SELECT j.DFRcode, j.FOID, j.seq,
         CASE WHEN cap IS NOT NULL THEN cap
              WHEN code IS NULL THEN 'a referenced row does not exist'
              WHEN full_up THEN 'the discount has reached its usage limit'
              WHEN seq > first_seq THEN 'duplicate key' END AS error
  FROM t_app_judged j LEFT JOIN t_app_place p ON p.DFRcode = j.DFRcode AND p.FOID = j.FOID),
t_bad_customer AS (
  SELECT c_custkey + 1000 AS ID, CASE WHEN c_acctbal < 0 THEN repeat(c_name, 6) ELSE c_name END AS name,
         CASE WHEN c_acctbal < 1000 THEN 'c' || c_custkey || '@mail-' || lower(c_mktsegment) || '.com'
              WHEN c_acctbal < 2000 THEN NULL ELSE 'c' || c_custkey || '@mail.vn' END AS email,
         CASE WHEN c_acctbal < 500 THEN NULL
              WHEN c_acctbal < 3000 THEN '1' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')
              WHEN c_acctbal < 4000 THEN '09' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0')
              ELSE '0' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS phone_number,
         CASE WHEN c_acctbal < 200 THEN NULL ELSE 'Street' END AS address,
         lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS card_number, c_mktsegment AS bank_name
  FROM customer),
t_bad_order AS (
  SELECT ID, CID, RID, FDID,
         CASE WHEN o_totalprice < 50000 THEN 'shipped' ELSE order_status END AS order_status,
         CASE WHEN o_totalprice < 20000 THEN 'card' ELSE Payment_method END AS Payment_method,
         CASE WHEN o_totalprice < 60000 THEN 6 WHEN o_totalprice < 70000 THEN 0 ELSE rating END AS rating,
         CASE WHEN o_totalprice < 30000 THEN -1 ELSE delivery_fee END AS delivery_fee
  FROM t_order),
t_bad_discount AS (
  SELECT 'DIS_' || s_suppkey AS code,
         CASE WHEN s_acctbal < 1000 THEN NULL WHEN s_acctbal < 2000 THEN -1 ELSE 10 END AS usageLimit,
         CASE WHEN s_acctbal < 4000 THEN 11 ELSE 10 END AS used_Count,
         CASE WHEN s_acctbal < 5000 THEN 8 ELSE 7 END AS days,
         CASE WHEN s_acctbal < 500 THEN 0 ELSE 5000 END AS value FROM supplier),
t_bad_customer_rows AS (
  SELECT 'customer' AS "table", 'not_null' AS rule, CAST(ID AS VARCHAR) AS key,
         concat_ws(',', CASE WHEN phone_number IS NULL THEN 'phone_number' END,
                   CASE WHEN address IS NULL THEN 'address' END) AS detail
  FROM t_bad_customer WHERE phone_number IS NULL OR address IS NULL),
t_bad_customer_length AS (
  SELECT 'customer' AS "table", 'length_name' AS rule, CAST(ID AS VARCHAR) AS key,
         CAST(length(name) AS VARCHAR) AS detail FROM t_bad_customer WHERE length(name) > 100),
t_bad_phone AS (
  SELECT 'customer' AS "table", 'unique_phone_number' AS rule, phone_number AS key, CAST(count(*) AS VARCHAR) AS detail
  FROM t_bad_customer WHERE phone_number IS NOT NULL GROUP BY phone_number HAVING count(*) > 1),
t_bad_order_domain AS (
  SELECT 'food_order' AS "table", 'domain_order_status' AS rule, CAST(ID AS VARCHAR) AS key, order_status AS detail
  FROM t_bad_order WHERE order_status NOT IN ('pending', 'confirmed', 'delivered', 'cancelled')
  UNION ALL
  SELECT 'food_order', 'domain_Payment_method', CAST(ID AS VARCHAR), Payment_method
  FROM t_bad_order WHERE Payment_method NOT IN ('CARD', 'CASH')),
t_bad_order_check AS (
  SELECT 'food_order' AS "table", 'rating_one_to_five' AS rule, CAST(ID AS VARCHAR) AS key,
         'rating >= 1 AND rating <= 5' AS detail FROM t_bad_order WHERE NOT (rating >= 1 AND rating <= 5)
  UNION ALL
  SELECT 'food_order', 'delivery_fee_not_negative', CAST(ID AS VARCHAR), 'delivery_fee >= 0'
  FROM t_bad_order WHERE NOT (delivery_fee >= 0)),
t_bad_line_key AS (
  SELECT 'contain' AS "table", 'key_FOID_FIID' AS rule, FOID || '|' || FIID AS key, CAST(count(*) AS VARCHAR) AS detail
  FROM t_line_raw GROUP BY FOID, FIID HAVING count(*) > 1),
t_item_request AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'dish ' || o_custkey END AS name,
         CAST((floor(o_totalprice / 100000) - 1) * 1000 AS INT) AS price, o_custkey % 280 AS categoryID,
         'Brand ' || chr(CAST(o_custkey % 27 + 65 AS INT)) AS restaurant,
         list_extract(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], o_custkey % 6 + 1) AS category,
         o_custkey * 2 AS ID FROM orders),
t_item_judged AS (
  SELECT r.*, CASE WHEN name = '' THEN 'The food name field cannot be blank'
                   WHEN price <= 0 THEN 'The food price must be greater 0'
                   WHEN categoryID NOT IN (SELECT ID FROM t_category)
                   THEN 'The new category has not been added' END AS ladder
  FROM t_item_request r),
t_item_add AS (
  SELECT *, CASE WHEN seq > min(CASE WHEN ladder IS NULL THEN seq END)
                              OVER (PARTITION BY name, price, categoryID)
                 THEN 'Already add this food item' ELSE ladder END AS error
  FROM t_item_judged),
t_named_resolved AS (
  SELECT r.seq, r.name, r.price, r.ID, c.ID AS categoryID
  FROM t_item_request r
  LEFT JOIN (SELECT min(c.ID) AS ID, t.name AS rname, c.name AS cname
             FROM t_category c JOIN t_restaurant t ON c.RID = t.ID GROUP BY ALL) c
  ON c.rname = r.restaurant AND c.cname = r.category),
t_named_add AS (
  SELECT *, CASE WHEN categoryID IS NULL THEN 'Category not found.'
                 WHEN seq > min(CASE WHEN name <> '' AND price > 0 AND categoryID IS NOT NULL THEN seq END)
                            OVER (PARTITION BY name, price, categoryID) THEN 'Already add this food item'
                 WHEN name = '' THEN 'The food name field cannot be blank'
                 WHEN price <= 0 THEN 'The food price must be greater 0' END AS error
  FROM t_named_resolved),
t_update AS (
  SELECT seq, ID, name, price, categoryID,
         CASE WHEN ID NOT IN (SELECT ID FROM t_item) THEN 'The food item does not exists'
              WHEN price <= 0 THEN 'The food price must be greater 0'
              WHEN categoryID NOT IN (SELECT ID FROM t_category) THEN 'The category does not exist' END AS error
  FROM t_item_request),
t_named_update AS (
  SELECT seq, ID, name, price, categoryID,
         CASE WHEN categoryID IS NULL THEN 'Category not found.'
              WHEN ID NOT IN (SELECT ID FROM t_item) THEN 'The food item does not exists'
              WHEN price <= 0 THEN 'The food price must be greater 0' END AS error
  FROM t_named_resolved),
t_events_lag AS (
  SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
  FROM events),
t_snapshot_points AS (
  SELECT user_id + 1000 AS CID, CAST(20 * count(*) AS BIGINT) AS points FROM t_events_lag
  WHERE previous = 'view' AND event_type = 'purchase' GROUP BY user_id),
t_change_points AS (
  SELECT user_id + 1000 AS CID, CAST(20 * count(*) AS BIGINT) AS points FROM events
  WHERE event_type = 'purchase' GROUP BY user_id)
"""

_RESTAURANT_MSG = "'Food item does not belong to the same restaurant as the food order.'"

_LINES_JUDGED = """
SELECT l.FOID, l.FIID, l.quantity, CASE WHEN i.RID = o.RID THEN NULL ELSE {message} END AS error
FROM {lines} l LEFT JOIN t_order o ON l.FOID = o.ID LEFT JOIN t_item i ON l.FIID = i.ID"""

_OUTCOME = """
SELECT ID, name, price, categoryID, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error FROM t_item
UNION ALL
SELECT (SELECT max(ID) FROM t_item) + row_number() OVER (ORDER BY seq), name, price, categoryID, NULL, NULL
FROM {judged} WHERE error IS NULL
UNION ALL
SELECT NULL, name, price, {category}, seq, error FROM {judged} WHERE error IS NOT NULL"""

_UPDATED = """
SELECT i.ID, coalesce(u.name, i.name) AS name, coalesce(u.price, i.price) AS price,
       coalesce(u.categoryID, i.categoryID) AS categoryID,
       CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error
FROM t_item i LEFT JOIN (SELECT * FROM {judged} WHERE error IS NULL
                         QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq DESC) = 1) u ON i.ID = u.ID
UNION ALL
SELECT ID, name, price, {category}, seq, error FROM {judged} WHERE error IS NOT NULL"""

# rows that go with a set of orders, customers or discounts: (table, key)
_ORDER_TREE = """
SELECT 'food_order' AS "table", CAST(ID AS VARCHAR) AS key FROM t_order WHERE ID IN (SELECT ID FROM gone_order)
UNION ALL SELECT 'contain', FOID || '|' || FIID FROM t_line WHERE FOID IN (SELECT ID FROM gone_order)
UNION ALL SELECT 'apply_for', DFRcode || '|' || FOID FROM t_apply WHERE FOID IN (SELECT ID FROM gone_order)
UNION ALL SELECT 'discount_point_apply_for', code || '|' || FOID FROM t_points
          WHERE FOID IN (SELECT ID FROM gone_order){or_points}"""

_CUSTOMER_TREE = _ORDER_TREE.format(or_points=" OR CID IN (SELECT ID FROM gone_customer)") + """
UNION ALL SELECT 'customer', CAST(ID AS VARCHAR) FROM gone_customer
UNION ALL SELECT 'discount_from_exchange_point', code FROM t_points WHERE CID IN (SELECT ID FROM gone_customer)
UNION ALL SELECT 'use', CID || '|' || DFRcode FROM t_use WHERE CID IN (SELECT ID FROM gone_customer)"""

_BODIES = {
    "menu": """SELECT rname, p_type AS cname, name, price, ID FROM t_item""",
    "restaurant_categories": """
SELECT r.name AS restaurantname, CAST(0 AS BIGINT) AS page, string_agg(c.name, ',' ORDER BY c.ID) AS categories
FROM t_category c LEFT JOIN t_restaurant r ON c.RID = r.ID GROUP BY r.name""",
    "category_directory": """
SELECT c.ID, c.name AS categoryName, r.name AS resName FROM t_category c JOIN t_restaurant r ON c.RID = r.ID""",
    "customer_directory": "SELECT * FROM t_customer",
    "orders_with_discounts": "SELECT * FROM t_report",
    "orders_by_category": "SELECT * FROM t_by_category",
    "item_counts": """
SELECT r.name AS rname, c.ID AS categoryID, count(i.ID) AS total_food
FROM t_category c JOIN t_restaurant r ON c.RID = r.ID LEFT JOIN t_item i ON i.categoryID = c.ID GROUP BY r.name, c.ID""",
    "count_items": f""",
asked AS (
  SELECT ID AS seq, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN 'Nowhere Town' ELSE rname END
         AS restaurant_name,
         CASE WHEN p_size % 7 = 0 THEN -categoryID WHEN p_size % 11 = 0 THEN categoryID + 10 ELSE categoryID END
         AS category_id FROM t_item),
judged AS (
  SELECT *, CASE WHEN category_id < 0 THEN 'Category ID must be positive'
                 WHEN NOT regexp_matches(restaurant_name, '{rules.RESTAURANT_NAME}')
                 THEN 'Wrong restaurant format name!'
                 WHEN restaurant_name NOT IN (SELECT name FROM t_restaurant)
                 THEN 'Restaurant does not exist!' END AS error FROM asked)
SELECT seq, restaurant_name, category_id,
       CASE WHEN error IS NULL THEN (SELECT count(*) FROM t_item i WHERE i.categoryID = j.category_id
                                     AND i.rname = j.restaurant_name) END AS total_food, error
FROM judged j""",
    "price_levels": "SELECT * FROM t_level",
    "price_stats": "SELECT * FROM t_stats",
    "categorize_items": f""",
asked AS (
  SELECT ID AS seq, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE rname END AS restaurant_name,
         CASE WHEN p_size % 5 = 0 THEN name || '/x' WHEN p_size % 7 = 0 THEN name || '#1' ELSE name END AS food_name
  FROM t_item),
named AS (SELECT rname, name, count(*) AS same, min(price_level) AS price_level FROM t_level GROUP BY rname, name),
judged AS (
  SELECT a.*, n.price_level,
         CASE WHEN NOT regexp_matches(restaurant_name, '{rules.RESTAURANT_NAME}') THEN 'Wrong restaurant format name!'
              WHEN NOT regexp_matches(food_name, '{rules.ITEM_NAME}') THEN 'Invalid food name'
              WHEN same IS NULL THEN 'Food item does not exist in the restaurant!'
              WHEN same > 1 THEN 'more than one food item has this name' END AS error
  FROM asked a LEFT JOIN named n ON n.rname = a.restaurant_name AND n.name = a.food_name)
SELECT seq, restaurant_name, food_name, CASE WHEN error IS NULL THEN price_level END AS price_level, error
FROM judged""",
    "categorize_items_collated": f""",
asked AS (
  SELECT ID AS seq, upper(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE rname END) AS restaurant_name,
         lower(CASE WHEN p_size % 5 = 0 THEN name || '/x' WHEN p_size % 7 = 0 THEN name || '#1' ELSE name END) AS food_name
  FROM t_item),
named AS (SELECT upper(rname) AS rname, lower(name) AS name, count(*) AS same, min(price_level) AS price_level FROM t_level GROUP BY ALL),
judged AS (
  SELECT a.*, n.price_level,
         CASE WHEN NOT regexp_matches(restaurant_name, '{rules.RESTAURANT_NAME}') THEN 'Wrong restaurant format name!'
              WHEN NOT regexp_matches(food_name, '{rules.ITEM_NAME}') THEN 'Invalid food name'
              WHEN same IS NULL THEN 'Food item does not exist in the restaurant!'
              WHEN same > 1 THEN 'more than one food item has this name' END AS error
  FROM asked a LEFT JOIN named n ON n.rname = a.restaurant_name AND n.name = a.food_name)
SELECT seq, restaurant_name, food_name, CASE WHEN error IS NULL THEN price_level END AS price_level, error
FROM judged""",
    "count_food_sql": f""",
asked AS (
  SELECT ID AS seq, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 5 = 0 THEN 'Nowhere Town' ELSE rname END
         AS restaurant_name,
         CASE WHEN p_size % 7 = 0 THEN -categoryID WHEN p_size % 11 = 0 THEN categoryID + 10 ELSE categoryID END
         AS category_id FROM t_item),
judged AS (
  SELECT *, CASE WHEN category_id < 0 THEN 'Category ID must be positive'
                 WHEN NOT regexp_matches(restaurant_name, '{rules.RESTAURANT_NAME}')
                 THEN 'Wrong restaurant format name!'
                 WHEN restaurant_name NOT IN (SELECT name FROM t_restaurant)
                 THEN 'Restaurant does not exist!' END AS error FROM asked)
SELECT seq,
       CASE WHEN error IS NULL THEN (SELECT count(*) FROM t_item i WHERE i.categoryID = j.category_id
                                     AND i.rname = j.restaurant_name) END AS total_food
FROM judged j""",
    "categorize_food_sql": f""",
asked AS (
  SELECT ID AS seq, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE rname END AS restaurant_name,
         CASE WHEN p_size % 5 = 0 THEN name || '/x' WHEN p_size % 7 = 0 THEN name || '#1' ELSE name END AS food_name
  FROM t_item),
named AS (SELECT rname, name, count(*) AS same, min(price_level) AS price_level FROM t_level GROUP BY rname, name),
judged AS (
  SELECT a.*, n.price_level,
         CASE WHEN NOT regexp_matches(restaurant_name, '{rules.RESTAURANT_NAME}') THEN 'Wrong restaurant format name!'
              WHEN NOT regexp_matches(food_name, '{rules.ITEM_NAME}') THEN 'Invalid food name'
              WHEN same IS NULL THEN 'Food item does not exist in the restaurant!'
              WHEN same > 1 THEN 'more than one food item has this name' END AS error
  FROM asked a LEFT JOIN named n ON n.rname = a.restaurant_name AND n.name = a.food_name)
SELECT seq, CASE WHEN error IS NULL THEN price_level END AS price_level
FROM judged""",
    "price_levels_sql": "SELECT r.ID AS RID, l.ID, l.name, price, price_level FROM t_level l JOIN t_restaurant r ON r.name = rname",
    "resolve_category": """,
asked AS (SELECT ID AS seq, rname AS restaurant, CASE WHEN p_size % 4 = 0 THEN lower(p_type) ELSE p_type END AS category
          FROM t_item)
SELECT seq, restaurant, category,
       (SELECT min(c.ID) FROM t_category c JOIN t_restaurant r ON c.RID = r.ID
        WHERE r.name = restaurant AND c.name = category) AS categoryID FROM asked""",
    "refine_orders": "SELECT * FROM t_report WHERE OrderStatus = 'delivered' AND rating = 3",
    "refine_orders_by_name": """
SELECT * FROM t_by_category WHERE OrderStatus = 'confirmed' AND contains(CustomerName, '7')""",
    "lookup_items": """
SELECT ID, name, price, image, categoryID FROM t_item WHERE ID IN (SELECT o_custkey * 2 FROM orders)""",
    "order_totals": "SELECT * FROM t_total",
    "order_costs": """
SELECT ID, coalesce(total + delivery_fee, 0) AS orderCost FROM t_order LEFT JOIN t_total ON FOID = ID""",
    "discount_usage": """
SELECT code, used_Count + count(FOID) AS used_Count FROM t_dfr LEFT JOIN t_apply ON DFRcode = code
GROUP BY code, used_Count""",
    "loyalty_points": """
SELECT ID, exchange_points + coalesce(points, 0) AS exchange_points
FROM t_customer LEFT JOIN t_snapshot_points ON CID = ID""",
    "loyalty_points_from_changes": """
SELECT ID, exchange_points + coalesce(points, 0) AS exchange_points
FROM t_customer LEFT JOIN t_change_points ON CID = ID""",
    "admit_applications": "SELECT * FROM t_admission",
    "q_not_null": "SELECT * FROM t_bad_customer_rows",
    "q_key": "SELECT * FROM t_bad_line_key",
    "q_unique": "SELECT * FROM t_bad_phone",
    "q_foreign_key": """
SELECT 'contain' AS "table", 'foreign_key_FIID' AS rule, FOID || '|' || FIID AS key, CAST(FIID AS VARCHAR) AS detail
FROM t_line WHERE FIID NOT IN (SELECT ID FROM t_item WHERE p_type <> 'PROMO')""",
    "q_domain": "SELECT * FROM t_bad_order_domain",
    "q_length": "SELECT * FROM t_bad_customer_length",
    "q_checks": """
SELECT * FROM t_bad_order_check
UNION ALL
SELECT 'discount_from_restaurant', 'value_positive', code, 'value > 0' FROM t_bad_discount WHERE NOT (value > 0)
UNION ALL
SELECT 'discount_from_restaurant', 'usage_within_limit', code, 'usageLimit >= 0 AND used_Count <= usageLimit'
FROM t_bad_discount WHERE NOT (usageLimit >= 0 AND used_Count <= usageLimit)""",
    "q_window": """
SELECT 'discount_from_restaurant' AS "table", 'valid_seven_days' AS rule, code AS key,
       'end_date = date_add(start_date, 7)' AS detail FROM t_bad_discount WHERE days <> 7""",
    "q_check_all": """
SELECT * FROM t_bad_customer_rows UNION ALL SELECT * FROM t_bad_customer_length
UNION ALL SELECT * FROM t_bad_phone UNION ALL SELECT * FROM t_bad_order_domain
UNION ALL SELECT * FROM t_bad_order_check UNION ALL SELECT * FROM t_bad_line_key""",
    "q_references": """,
gone AS (SELECT ID FROM t_customer WHERE bank_name = 'MACHINERY'),
codes AS (SELECT code FROM t_dfr WHERE value > 100000)
SELECT 'food_item' AS "table", 'foreign_key_categoryID' AS rule, CAST(ID AS VARCHAR) AS key, CAST(categoryID AS VARCHAR) AS detail
FROM t_item WHERE categoryID IN (SELECT ID FROM t_category WHERE name = 'PROMO')
UNION ALL SELECT 'food_order', 'foreign_key_CID', CAST(ID AS VARCHAR), CAST(CID AS VARCHAR) FROM t_order WHERE CID IN (SELECT ID FROM gone)
UNION ALL SELECT 'use', 'foreign_key_CID', CID || '|' || DFRcode, CAST(CID AS VARCHAR) FROM t_use WHERE CID IN (SELECT ID FROM gone)
UNION ALL SELECT 'discount_from_exchange_point', 'foreign_key_CID', code, CAST(CID AS VARCHAR) FROM t_points WHERE CID IN (SELECT ID FROM gone)
UNION ALL SELECT 'use', 'foreign_key_DFRcode', CID || '|' || DFRcode, DFRcode FROM t_use WHERE DFRcode NOT IN (SELECT code FROM codes)
UNION ALL SELECT 'apply_for', 'foreign_key_DFRcode', DFRcode || '|' || FOID, DFRcode FROM t_apply WHERE DFRcode NOT IN (SELECT code FROM codes)""",
    "q_split_valid": """
SELECT ID, CASE WHEN phone_number IS NULL OR address IS NULL THEN 'not_null'
                WHEN length(name) > 100 THEN 'length_name' END AS error FROM t_bad_customer""",
    "q_line_restaurant": _LINES_JUDGED.format(lines="t_line", message=_RESTAURANT_MSG),
    "q_discount_cap": """
SELECT DFRcode, a.FOID, CASE WHEN CAST(value AS BIGINT) * 100 > total * 30
                             THEN 'The discount exceeds 30% of the total food order price.' END AS error
FROM t_apply a LEFT JOIN t_dfr ON DFRcode = code LEFT JOIN t_total t ON t.FOID = a.FOID""",
    "q_combined_cap": """
SELECT p.code AS DFEPcode, p.FOID,
       CASE WHEN (CAST(p.value AS BIGINT) + r.value) * 100 > total * 30
            THEN 'The total discount exceeds 30% of the total food order price.' END AS error
FROM t_points p LEFT JOIN (SELECT FOID, value FROM t_apply JOIN t_dfr ON DFRcode = code) r ON r.FOID = p.FOID
LEFT JOIN t_total t ON t.FOID = p.FOID""",
    "q_formats": f""",
odd AS (
  SELECT CAST(ID AS VARCHAR) AS key, p_brand, p_size - 5 AS size,
         CASE WHEN p_size % 4 = 0 THEN name || '/2' WHEN p_size % 9 = 0 THEN ''
              WHEN p_size % 5 = 0 THEN name || '#2' ELSE name END AS name FROM t_item)
SELECT 'customer' AS "table", 'email' AS rule, CAST(ID AS VARCHAR) AS key, email AS detail FROM t_bad_customer
WHERE NOT regexp_matches(email, '{rules.EMAIL}')
UNION ALL SELECT 'customer', 'phone', CAST(ID AS VARCHAR), phone_number FROM t_bad_customer
WHERE strlen(phone_number) <> 10 OR NOT regexp_matches(phone_number, '{rules.PHONE}')
UNION ALL SELECT 'customer', 'password', CAST(ID AS VARCHAR), bank_name FROM t_bad_customer
WHERE strlen('mậ' || bank_name) < 8
UNION ALL SELECT 'food_item', 'blank', key, name FROM odd WHERE name = ''
UNION ALL SELECT 'food_item', 'item_name', key, name FROM odd WHERE NOT regexp_matches(name, '{rules.ITEM_NAME}')
UNION ALL SELECT 'food_item', 'restaurant_name', key, p_brand FROM odd
WHERE NOT regexp_matches(p_brand, '{rules.RESTAURANT_NAME}')
UNION ALL SELECT 'food_item', 'category_id', key, CAST(size AS VARCHAR) FROM odd WHERE size < 0
UNION ALL SELECT 'food_item', 'price', key, CAST(size AS VARCHAR) FROM odd WHERE size <= 0""",
    "q_exists": """
SELECT o_orderkey AS seq, o_custkey * 2 AS ID, o_custkey * 2 IN (SELECT ID FROM t_item) AS found FROM orders""",
    "q_exists_collated": """,
asked AS (
  SELECT ID AS seq, CASE WHEN p_size % 2 = 0 THEN replace(upper(rname), 'A', 'À')
                         WHEN p_size % 3 = 0 THEN rname || ' ' ELSE lower(rname) END AS name FROM t_item)
SELECT seq, name, lower(strip_accents(name)) IN (SELECT lower(name) FROM t_restaurant) AS found FROM asked""",
    "q_duplicates": """
SELECT seq, coalesce(seq > min(seq) OVER (PARTITION BY name, price, categoryID), false)
       OR EXISTS (SELECT 1 FROM t_item i WHERE i.name = r.name AND i.price = r.price
                  AND i.categoryID = r.categoryID) AS duplicate
FROM t_item_request r""",
    "q_first_error": "SELECT seq, ladder AS error FROM t_item_judged",
    "add_items": _OUTCOME.format(judged="t_item_add", category="categoryID"),
    "add_items_by_name": _OUTCOME.format(judged="t_named_add", category="NULL"),
    "update_items": _UPDATED.format(judged="t_update", category="categoryID"),
    "update_items_by_name": _UPDATED.format(judged="t_named_update", category="NULL"),
    "delete_items": """,
judged AS (
  SELECT seq, ID * 2 AS ID, ID * 2 IN (SELECT ID FROM t_item) AND seq = min(seq) OVER (PARTITION BY ID) AS good
  FROM t_item_request)
SELECT 'food_item' AS "table", CAST(ID AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS error FROM judged WHERE good
UNION ALL SELECT 'contain', FOID || '|' || FIID, NULL FROM t_line WHERE FIID IN (SELECT ID FROM judged WHERE good)
UNION ALL SELECT 'request', CAST(seq AS VARCHAR), 'The food item does not exist' FROM judged WHERE NOT good""",
    "delete_orders": """,
judged AS (
  SELECT event_id AS seq, (event_id >> 1) * 4 AS ID,
         (event_id >> 1) * 4 IN (SELECT ID FROM t_order)
         AND event_id = min(event_id) OVER (PARTITION BY event_id >> 1) AS good FROM events),
gone_order AS (SELECT ID FROM judged WHERE good)
SELECT *, CAST(NULL AS VARCHAR) AS error FROM (""" + _ORDER_TREE.format(or_points="") + """)
UNION ALL SELECT 'request', CAST(seq AS VARCHAR), 'Order not found' FROM judged WHERE NOT good""",
    "items_in_place": """,
gone_item AS (SELECT DISTINCT ID * 2 AS ID FROM t_item_request),
priced AS (
  SELECT i.ID, coalesce(u.price, i.price) AS price FROM t_item i LEFT JOIN (
    SELECT * FROM t_update WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq DESC) = 1) u ON i.ID = u.ID)
SELECT ID, price, CAST(NULL AS BIGINT) AS FOID FROM priced WHERE ID NOT IN (SELECT ID FROM gone_item)
UNION ALL SELECT FIID, quantity, FOID FROM t_line WHERE FIID NOT IN (SELECT ID FROM gone_item)""",
    "maintained_totals": """,
gone_item AS (SELECT DISTINCT ID * 2 AS ID FROM t_item_request),
gone_order AS (SELECT DISTINCT (event_id >> 1) * 4 AS ID FROM events),
priced AS (
  SELECT i.ID, coalesce(u.price, i.price) AS price FROM t_item i LEFT JOIN (
    SELECT * FROM t_update WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY ID ORDER BY seq DESC) = 1) u ON i.ID = u.ID)
SELECT FOID, CAST(sum(CAST(price AS BIGINT) * quantity) AS BIGINT) AS total, count(*) AS lines
FROM t_line JOIN priced ON FIID = priced.ID
WHERE FIID NOT IN (SELECT ID FROM gone_item) AND FOID NOT IN (SELECT ID FROM gone_order) GROUP BY FOID""",
    "maintained_usage": """
SELECT DFRcode, count(*) AS n FROM (
  SELECT DFRcode FROM t_apply WHERE FOID NOT IN (SELECT (event_id >> 1) * 4 FROM events)
  UNION ALL SELECT 'DIS_' || o_orderkey % 7 FROM orders) GROUP BY DFRcode""",
    "add_accounts": """,
asked AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
                               ELSE 'user' || user_id END AS username,
         substring(props, 1, event_id % 5 + 5) AS password FROM events),
judged AS (
  SELECT *, CASE WHEN username IN (SELECT username FROM t_account)
                      OR seq > min(CASE WHEN strlen(password) >= 8 THEN seq END) OVER (PARTITION BY username)
                 THEN 'Tên đăng nhập đã tồn tại'
                 WHEN strlen(password) < 8 THEN 'Vui lòng nhập mật khẩu ít nhất 8 kí tự' END AS error FROM asked)
SELECT ID, username, password, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error FROM t_account
UNION ALL
SELECT (SELECT max(ID) FROM t_account) + row_number() OVER (ORDER BY seq), username, password, NULL, NULL
FROM judged WHERE error IS NULL
UNION ALL SELECT NULL, username, password, seq, error FROM judged WHERE error IS NOT NULL""",
    "delete_accounts": """,
asked AS (
  SELECT c_custkey AS seq, c_name AS username,
         CASE WHEN c_acctbal < 5000 THEN 'wrong password' ELSE c_mktsegment || c_nationkey END AS password FROM customer
  UNION ALL SELECT -p_partkey - 1, p_brand, 'secret-' || p_brand FROM part),
matched AS (
  SELECT seq, a.ID, min(seq) OVER (PARTITION BY a.ID) AS first
  FROM asked LEFT JOIN t_account a USING (username, password)),
judged AS (
  SELECT seq, ID, CASE WHEN ID IN (SELECT RID FROM t_dfr) AND ID < 1000
                       THEN 'rows that must not be deleted refer to this one'
                       WHEN ID IS NULL OR seq > first THEN 'Tên đăng nhập không tồn tại' END AS error FROM matched),
gone AS (SELECT ID FROM judged WHERE error IS NULL),
gone_customer AS (SELECT ID FROM t_customer WHERE ID IN (SELECT ID FROM gone)),
gone_restaurant AS (SELECT ID FROM t_restaurant WHERE ID IN (SELECT ID FROM gone)),
gone_order AS (SELECT ID FROM t_order WHERE CID IN (SELECT ID FROM gone_customer)
               OR RID IN (SELECT ID FROM gone_restaurant)),
gone_item AS (SELECT ID FROM t_item WHERE RID IN (SELECT ID FROM gone_restaurant)),
tree AS (""" + _CUSTOMER_TREE + """
UNION ALL SELECT 'account', CAST(ID AS VARCHAR) FROM gone
UNION ALL SELECT 'restaurant', CAST(ID AS VARCHAR) FROM gone_restaurant
UNION ALL SELECT 'category', CAST(ID AS VARCHAR) FROM t_category WHERE RID IN (SELECT ID FROM gone_restaurant)
UNION ALL SELECT 'food_item', CAST(ID AS VARCHAR) FROM gone_item
UNION ALL SELECT 'contain', FOID || '|' || FIID FROM t_line WHERE FIID IN (SELECT ID FROM gone_item)
          AND FOID NOT IN (SELECT ID FROM gone_order))
SELECT *, CAST(NULL AS VARCHAR) AS error FROM tree
UNION ALL SELECT 'request', CAST(seq AS VARCHAR), error FROM judged WHERE error IS NOT NULL""",
    "cascade_delete": """,
gone_customer AS (SELECT c_custkey + 1000 AS ID FROM customer WHERE c_acctbal < 0),
gone_order AS (SELECT ID FROM t_order WHERE CID IN (SELECT ID FROM gone_customer))
SELECT *, CAST(NULL AS VARCHAR) AS error FROM (""" + _CUSTOMER_TREE + ")",
    "retire_discounts": """,
gone AS (SELECT code FROM t_dfr d WHERE (SELECT count(*) FROM t_apply WHERE DFRcode = d.code) > 0
         AND used_Count + (SELECT count(*) FROM t_apply WHERE DFRcode = d.code) + 1 >= usageLimit)
SELECT 'discount_from_restaurant' AS "table", code AS key, CAST(NULL AS VARCHAR) AS error FROM gone
UNION ALL SELECT 'use', CID || '|' || DFRcode, NULL FROM t_use WHERE DFRcode IN (SELECT code FROM gone)
UNION ALL SELECT 'apply_for', DFRcode || '|' || FOID, NULL FROM t_apply WHERE DFRcode IN (SELECT code FROM gone)""",
    "load_defaults_ids": """
SELECT ID AS seq, (SELECT max(ID) FROM t_order) + row_number() OVER (ORDER BY ID) AS ID,
       'pending' AS order_status, CAST(0 AS BIGINT) AS orderCost FROM t_order""",
    "load_items": """,
judged AS (
  SELECT seq, (SELECT max(ID) FROM t_item) + row_number() OVER (ORDER BY seq) AS ID, name, price, categoryID,
         CASE WHEN NOT (price > 0) THEN 'price_positive'
              WHEN categoryID NOT IN (SELECT ID FROM t_category) THEN 'foreign_key_categoryID' END AS error
  FROM t_item_request)
SELECT ID, name, price, categoryID, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error FROM t_item
UNION ALL SELECT ID, name, price, categoryID, NULL, NULL FROM judged WHERE error IS NULL
UNION ALL SELECT NULL, name, price, categoryID, seq, error FROM judged WHERE error IS NOT NULL""",
    "load_items_refused": """,
judged AS (
  SELECT CASE WHEN NOT (price > 0) THEN 'price_positive'
              WHEN categoryID NOT IN (SELECT ID FROM t_category) THEN 'foreign_key_categoryID' END AS rule
  FROM t_item_request)
SELECT rule, count(*) AS refused FROM judged WHERE rule IS NOT NULL GROUP BY rule""",
    "text_formats": """
SELECT ID, strftime(order_time_stamp, '%Y-%m-%d %H:%M:%S') AS at,
       replace(format('{:,}', CID * delivery_fee), ',', '.') || chr(160) || '₫' AS amount,
       CASE WHEN rating IS NULL OR rating = 0 THEN 5 ELSE rating END AS stars FROM t_order""",
    "text_formats_sql": f"""
SELECT ID, email, regexp_matches(email, '{rules.EMAIL}') AS good_email,
       strlen(phone_number) = 10 AND regexp_matches(phone_number, '{rules.PHONE}') AS good_phone,
       strlen(bank_name) >= 8 AS good_password,
       replace(format('{{:,}}', ID * 1000), ',', '.') || chr(160) || '₫' AS amount,
       CAST(CASE WHEN ID % 3 = 0 THEN 5 ELSE ID % 3 END AS INT) AS stars FROM t_bad_customer""",
    "stream_points": "SELECT * FROM t_change_points",
    "stream_points_from_snapshots": "SELECT * FROM t_snapshot_points",
    "stream_points_late": "SELECT * FROM t_snapshot_points",
    "stream_order_cost": """
SELECT ID, coalesce(total + delivery_fee, 0) AS orderCost FROM t_order LEFT JOIN t_total ON FOID = ID""",
    "stream_usage": """
SELECT code, used_Count + count(FOID) AS used_Count FROM t_dfr LEFT JOIN t_apply ON DFRcode = code
GROUP BY code, used_Count""",
    "stream_rejects": "SELECT *, error IS NULL AS accepted FROM ("
                      + _LINES_JUDGED.format(lines="t_line_raw", message=_RESTAURANT_MSG) + ")",
    "stream_discount_rejects": "SELECT DFRcode, FOID, seq, cap AS error, cap IS NULL AS accepted FROM t_app_judged",
    "stream_admission": "SELECT * FROM t_admission",
    "orders_with_discounts_of_customer": """
SELECT * FROM t_report WHERE OrderID IN (SELECT ID FROM t_order WHERE CID = 1004)""",
    "orders_with_several_discounts": """,
given AS (
  SELECT FOID, value FROM (
    SELECT DFRcode, FOID FROM t_apply_some UNION ALL
    SELECT 'DIS_' || o_orderkey % 7, o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH') a
  JOIN t_dfr ON DFRcode = code),
sums AS (SELECT FOID, CAST(sum(value) AS BIGINT) AS value FROM given GROUP BY FOID)
SELECT o.ID AS OrderID, Payment_method, address AS OrderAddress, order_status AS OrderStatus,
       order_time_stamp AS OrderTimestamp, review, rating, ship_status AS ShippingStatus,
       get_status AS GetStatus, delivery_fee, total AS TotalOrderPrice,
       coalesce(r.value, 0) AS RestaurantDiscount, CAST(coalesce(p.value, 0) AS BIGINT) AS ExchangePointDiscount,
       coalesce(r.value, 0) + CAST(coalesce(p.value, 0) AS BIGINT) AS TotalDiscount
FROM t_order o LEFT JOIN t_total ON t_total.FOID = o.ID
LEFT JOIN sums r ON r.FOID = o.ID LEFT JOIN t_points_some p ON p.FOID = o.ID
WHERE r.FOID IS NOT NULL OR p.FOID IS NOT NULL""",
    "orders_of_category": """
SELECT OrderID, OrderTime, rating, CustomerName, TotalItems, OrderStatus, TotalRevenue
FROM t_by_category WHERE categoryID = 12 ORDER BY TotalRevenue DESC, OrderID""",
    "price_levels_of_restaurant": "SELECT * FROM t_level WHERE rname = 'Brand B'",
    "lookup_item": "SELECT ID, name, price, image, categoryID FROM t_item WHERE ID = 17",
    "lookup_items_listed": "SELECT ID, name, price, image, categoryID FROM t_item WHERE ID IN (3, 4, 150, -1)",
    "load_items_csv": """
SELECT name, price, categoryID, CAST(NULL AS VARCHAR) AS error FROM t_item
UNION ALL
SELECT name, price, categoryID,
       CASE WHEN NOT (price > 0) THEN 'price_positive'
            WHEN categoryID NOT IN (SELECT ID FROM t_category) THEN 'foreign_key_categoryID' END
FROM t_item_request""",
    "load_items_strict": """
SELECT ID, name, price, categoryID FROM t_item
UNION ALL
SELECT (SELECT max(ID) FROM t_item) + row_number() OVER (ORDER BY seq), name, price, categoryID
FROM t_item_request WHERE name <> '' AND price > 0 AND categoryID IN (SELECT ID FROM t_category)""",
}
_BODIES |= {f"{name}_batches": body for name, body in _BODIES.items() if name.startswith("stream_") and not name.endswith("_late")}

# Requests are taken one after another: each step looks at the keys given out so far.
_ADD_CUSTOMERS = """,
asked AS (
  SELECT c_custkey AS seq, CASE WHEN c_nationkey = 3 THEN c_name || 'x' ELSE c_name END AS username, c_name AS name,
         CASE WHEN c_acctbal < 0 THEN 'a@b-c.com' ELSE 'c' || c_custkey || '@mail.com' END AS email,
         CASE WHEN c_nationkey = 5 THEN '1' ELSE '0' END || lpad(CAST(c_custkey >> 4 AS VARCHAR), 9, '0') AS phone_number,
         lpad(CAST(c_custkey // 24 AS VARCHAR), 16, '0') AS card_number FROM customer),
stored AS (SELECT ID, name, '2' || substring(phone_number, 2, 9) AS phone_number,
                  '2' || substring(card_number, 2, 15) AS card_number
           FROM t_customer WHERE bank_name <> 'MACHINERY'),
judged AS (
  SELECT a.*, t.ID, CASE WHEN t.ID IS NULL THEN 'Customer does not have an username'
                         WHEN NOT regexp_matches(email, '{email}') THEN 'Invalid Email address'
                         WHEN strlen(phone_number) <> 10 OR NOT regexp_matches(phone_number, '{phone}')
                         THEN 'Invalid phone number (must have 10 number digits)'
                         WHEN t.ID IN (SELECT ID FROM stored) THEN 'duplicate key' END AS error
  FROM asked a LEFT JOIN t_account t USING (username)),
open AS (SELECT *, row_number() OVER (ORDER BY seq) AS step FROM judged WHERE error IS NULL),
settled AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS seq, false AS taken,
         CAST([] AS VARCHAR[]) AS phones, CAST([] AS VARCHAR[]) AS cards
  UNION ALL
  SELECT o.step, o.seq, free, CASE WHEN free THEN list_append(phones, phone_number) ELSE phones END,
         CASE WHEN free THEN list_append(cards, card_number) ELSE cards END
  FROM (SELECT s.phones, s.cards, o.*, NOT list_contains(s.phones, o.phone_number)
               AND NOT list_contains(s.cards, o.card_number) AS free
        FROM settled s JOIN open o ON o.step = s.step + 1) o),
final AS (
  SELECT j.* EXCLUDE (error), coalesce(j.error, CASE WHEN NOT s.taken THEN 'duplicate key' END) AS error
  FROM judged j LEFT JOIN settled s ON j.seq = s.seq)
SELECT ID, name, phone_number, card_number, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS error FROM stored
UNION ALL SELECT ID, name, phone_number, card_number, NULL, NULL FROM final WHERE error IS NULL
UNION ALL SELECT NULL, name, phone_number, card_number, seq, error FROM final WHERE error IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    """The SQL of each query; every text starts with the shared table definitions."""
    texts = {name: _TABLES.rstrip() + "\n" + body.lstrip("\n") for name, body in _BODIES.items()}
    texts["add_customers"] = (_TABLES.rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
                              + _ADD_CUSTOMERS.format(email=rules.EMAIL, phone=rules.PHONE))
    return texts
