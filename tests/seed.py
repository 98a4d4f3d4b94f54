"""A small marketplace with known results.

Fixed values: the rows below are the inputs the golden results were computed
from.  Columns no result depends on are filled by ``tables``.
"""

from pyspark.sql import functions as F

from tiffin.contracts import TABLES

CUSTOMER_POINTS = {1: 100, 2: 60, 3: 80, 4: 0, 5: 200, 11: 100, 12: 60, 13: 80}

RESTAURANTS = {
    6: "Bánh Mì Huynh Hoa", 7: "Cơm Tấm Phúc Lộc Thọ", 8: "Bún Thịt Nướng Hằng", 9: "Phở Việt Nam",
    10: "Pizza Company", 14: "NhahangHoangTam", 15: "DimTuTac", 16: "SanFoulu", 17: "BotChien", 18: "PizzaHut",
}

# code, usage limit, value, restaurant
RESTAURANT_DISCOUNTS = [
    ("DIS_HH5", 100, 5000, 6), ("DIS_PLT10", 10, 10000, 7), ("DIS_BTN20", 30, 20000, 8),
    ("DIS_PVN10", 20, 10000, 9), ("DIS_SPECIAL", 20, 20000, 6), ("DIS_HT5", 100, 5000, 14),
    ("DIS_DIMTUTAC10", 50, 10000, 15), ("DIS_SanFoulu20", 30, 20000, 16), ("DIS_BotChien10", 20, 10000, 17),
    ("DIS_SPECIAL2", 20, 20000, 18), ("DIS_COMPANY1", 20, 20000, 10),
]

# code, value, customer
POINT_DISCOUNTS = [
    ("EXC_NAM20", 5000, 1), ("EXC_MINH80", 30000, 2), ("EXC_LAM40", 15000, 3), ("EXC_PHU120", 50000, 5),
    ("EXC_DOE20", 5000, 11), ("EXC_SMITH80", 30000, 12), ("EXC_ALICE40", 15000, 13),
]

# name, restaurant; ids count from 1
CATEGORIES = [
    ("Bánh Mì", 6), ("Cơm", 7), ("Bún", 8), ("Phở", 9), ("Nước uống", 6), ("Nước uống", 7), ("Nước uống", 8),
    ("Nước uống", 9), ("pizza", 10), ("mì", 10), ("Bánh", 14), ("Mì", 15), ("Dimsum", 16), ("Đồ Chiên", 17),
    ("Pizza", 18), ("Gà", 18), ("Mì", 18), ("Salad", 18), ("Khoai tây chiên", 18), ("Nước uống", 18),
    ("Bánh", 6), ("Bơ", 6), ("Chà bông", 6), ("Cơm", 6), ("Chả lụa", 6), ("Pate", 6), ("Dăm bông", 6),
]

# price, category; ids count from 1
ITEMS = [
    (68000, 1), (30000, 1), (40000, 1), (90000, 2), (60000, 2), (45000, 2), (60000, 2), (80000, 2), (40000, 3),
    (45000, 4), (20000, 7), (10000, 8), (169000, 9), (139000, 10), (69000, 11), (350000, 12), (40000, 13),
    (30000, 14), (200000, 15), (79000, 16), (120000, 17), (89000, 15), (229000, 15), (229000, 15), (239000, 15),
    (59000, 19), (30000, 20), (30000, 20), (35000, 1), (65000, 1), (120000, 1), (50000, 1), (140000, 1),
    (90000, 1), (140000, 1), (159000, 9), (159000, 9), (149000, 9), (149000, 9), (149000, 9), (109000, 10),
]
ITEM_NAMES = {28: "Pepsi Lemon 320ml", 23: "Pizza Hải Sản Nhiệt Đới", 37: "Pizza Hải Sản Nhiệt Đới"}

# status, fee, customer, restaurant; ids count from 1
D, P, C = "delivered", "pending", "confirmed"
ORDERS = [
    (D, 15000, 1, 6), (D, 15000, 2, 7), (P, 15000, 3, 6), (P, 15000, 1, 10), (D, 25000, 11, 6), (D, 20000, 12, 15),
    (P, 10000, 13, 16), (D, 20000, 5, 6), (D, 15000, 4, 7), (D, 20000, 1, 10), (D, 15000, 3, 8), (D, 10000, 11, 9),
    (P, 15000, 2, 7), (P, 15000, 12, 6), (P, 10000, 13, 17), (C, 15000, 4, 7), (C, 15000, 11, 6), (C, 15000, 5, 6),
    (C, 15000, 5, 7), (C, 15000, 5, 8), (C, 15000, 12, 6), (C, 14000, 12, 7), (C, 15000, 12, 8), (C, 15000, 13, 10),
    (C, 13000, 13, 18), (C, 13000, 13, 6), (D, 15000, 1, 6), (D, 15000, 1, 7), (D, 25000, 1, 8), (C, 15000, 2, 6),
    (C, 15000, 2, 7), (C, 15000, 2, 8), (C, 15000, 3, 10), (C, 17000, 3, 18), (C, 15000, 3, 6), (C, 14000, 4, 10),
    (C, 16000, 4, 18), (C, 16000, 4, 6),
]

# order, item, quantity
LINES = [
    (1, 1, 3), (2, 4, 2), (3, 1, 3), (3, 2, 1), (4, 13, 2), (4, 14, 1), (5, 30, 2), (6, 16, 2), (7, 17, 3),
    (8, 1, 3), (8, 2, 4), (8, 3, 1), (9, 4, 3), (9, 6, 2), (9, 5, 1), (10, 36, 2), (10, 37, 2), (10, 38, 1),
    (10, 39, 5), (11, 9, 3), (12, 10, 2), (13, 8, 5), (13, 7, 1), (14, 1, 4), (15, 18, 2), (16, 8, 1), (16, 7, 3),
    (17, 1, 5), (18, 1, 2), (18, 2, 5), (19, 4, 5), (19, 5, 4), (20, 9, 3), (21, 32, 2), (21, 33, 4), (21, 34, 3),
    (22, 8, 1), (23, 9, 2), (24, 14, 5), (25, 22, 2), (26, 29, 3), (26, 30, 1), (27, 1, 2), (27, 2, 3), (28, 5, 1),
    (28, 6, 1), (29, 9, 7), (30, 2, 4), (30, 3, 5), (31, 5, 2), (31, 8, 3), (32, 9, 2), (33, 13, 3), (34, 22, 5),
    (35, 32, 2), (35, 34, 3), (36, 14, 2), (36, 13, 3), (37, 22, 2), (38, 1, 3), (38, 2, 3), (38, 3, 3),
]

# code -> orders it was applied to
APPLICATIONS = {
    "DIS_HH5": (1, 3, 5, 14, 18, 21, 26, 27, 30, 35, 38), "DIS_PLT10": (2, 9, 13, 16, 19, 22, 28, 31),
    "DIS_BTN20": (11, 20, 23, 29, 32), "DIS_PVN10": (12,), "DIS_COMPANY1": (4, 10, 24, 33, 36),
    "DIS_BotChien10": (15,), "DIS_SPECIAL2": (17, 25, 34, 37),
}


def _numbered(rows):
    return [(i, *row) for i, row in enumerate(rows, 1)]


def tables(spark):
    def frame(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    def full(name, df, **filled):
        for column, value in filled.items():
            df = df.withColumn(column, value)
        schema = TABLES[name].schema
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
                           else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    ids = [(i, f"user{i}", f"password{i}") for i in sorted({*CUSTOMER_POINTS, *RESTAURANTS})]
    key = F.col("ID").cast("string")
    day = F.lit("2024-12-01")
    apply_for = [(code, order) for code, orders in APPLICATIONS.items() for order in orders]
    return {
        "account": frame(ids, "ID long, username string, password string"),
        "customer": full(
            "customer", frame([(i, f"Customer {i}", p) for i, p in CUSTOMER_POINTS.items()],
                              "ID long, name string, exchange_points long"),
            phone_number=F.concat(F.lit("09"), F.lpad(key, 8, "0")), address=F.lit("street"),
            birthdate=F.lit("2004-08-15"), card_number=F.lpad(key, 16, "0")),
        "restaurant": full(
            "restaurant", frame(list(RESTAURANTS.items()), "ID long, name string"),
            phone_number=F.concat(F.lit("08"), F.lpad(key, 8, "0")), address=F.lit("street")),
        "discount_from_restaurant": full(
            "discount_from_restaurant",
            frame(RESTAURANT_DISCOUNTS, "code string, usageLimit long, value int, RID long"),
            used_Count=F.lit(0), start_date=day, end_date=F.lit("2024-12-08")),
        "discount_from_exchange_point": full(
            "discount_from_exchange_point", frame(POINT_DISCOUNTS, "code string, value int, CID long"),
            exchange_date=day, end_date=F.lit("2024-12-08")),
        "category": frame(_numbered(CATEGORIES), "ID long, name string, RID long"),
        "food_item": full(
            "food_item", frame([(i, ITEM_NAMES.get(i, f"item {i}"), p, c) for i, (p, c) in enumerate(ITEMS, 1)],
                               "ID long, name string, price int, categoryID long")),
        "food_deliver": frame([(1, "0911223344", "59A-12345", "courier")],
                              "ID long, phone_number string, vehicle_number string, name string"),
        "food_order": full(
            "food_order", frame(_numbered(ORDERS),
                                "ID long, order_status string, delivery_fee int, CID long, RID long"),
            Payment_method=F.lit("CASH"), address=F.lit("street"), order_time_stamp=F.lit("2024-12-02 08:15:00"),
            rating=F.lit(5), orderCost=F.lit(0), FDID=F.lit(1)),
        "use": frame([(1, "DIS_HH5")], "CID long, DFRcode string"),
        "contain": frame(LINES, "FOID long, FIID long, quantity int"),
        "apply_for": frame(apply_for, "DFRcode string, FOID long"),
        "discount_point_apply_for": frame([("EXC_MINH80", 2)], "DFEPcode string, FOID long"),
    }
