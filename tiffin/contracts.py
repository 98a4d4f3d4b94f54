"""Declarative contracts of the thirteen marketplace tables.

Spark enforces no keys, foreign keys or checks on Parquet, so each table states
them here and ``operators.quality`` turns them into whole-table jobs.

Identifiers, counters and summed money are BIGINT: they grow with the data and
would overflow INT long before the cluster is full.  Single prices, quantities
and fees stay INT.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
DAY, AT, WALL_CLOCK = T.DateType(), T.TimestampType(), T.TimestampNTZType()


@dataclass(frozen=True)
class Col:
    name: str
    type: T.DataType
    required: bool = False
    length: int | None = None
    domain: tuple[str, ...] = ()
    default: object = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str
    cascade: bool = True


@dataclass(frozen=True)
class Contract:
    columns: tuple[Col, ...]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    generated_key: bool = False

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])


def _text(name: str, length: int, required: bool = False, domain: tuple[str, ...] = (),
          default: str | None = None) -> Col:
    return Col(name, TEXT, required, length, domain, default)


def _req(name: str, type_: T.DataType = LONG, default: object = None) -> Col:
    return Col(name, type_, True, default=default)


# Lengths, domains, defaults and checks the data must satisfy.
TABLES: dict[str, Contract] = {
    "account": Contract(
        columns=(_req("ID"), _text("username", 100, True), _text("password", 100, True)),
        key=("ID",),
        unique=(("username",),),
        generated_key=True,
    ),
    "customer": Contract(
        columns=(
            _req("ID"), _text("name", 100, True), _text("email", 100),
            Col("exchange_points", LONG, default=0),
            _text("phone_number", 10, True), _text("address", 255, True), _req("birthdate", DAY),
            _text("card_number", 30, True), _text("bank_name", 100),
        ),
        key=("ID",),
        unique=(("phone_number",), ("card_number",)),
        foreign=(ForeignKey("ID", "account", "ID"),),
    ),
    "restaurant": Contract(
        columns=(
            _req("ID"), _text("name", 255, True), _text("phone_number", 10, True),
            _text("address", 255, True),
            # times of day as 'HH:mm:ss': stored, shown, never computed with
            Col("open_hour", TEXT), Col("close_hour", TEXT),
        ),
        key=("ID",),
        unique=(("phone_number",),),
        foreign=(ForeignKey("ID", "account", "ID"),),
    ),
    "discount_from_restaurant": Contract(
        columns=(
            _text("code", 100, True), Col("usageLimit", LONG), _req("used_Count"),
            _req("start_date", DAY), _req("end_date", DAY), _req("value", INT), _req("RID"),
        ),
        key=("code",),
        foreign=(ForeignKey("RID", "restaurant", "ID", cascade=False),),
        checks={
            "value_positive": "value > 0",
            "usage_within_limit": "usageLimit >= 0 AND used_Count <= usageLimit",
            "valid_seven_days": "end_date = date_add(start_date, 7)",
        },
    ),
    "discount_from_exchange_point": Contract(
        columns=(
            _text("code", 100, True), _req("exchange_date", WALL_CLOCK),
            _req("end_date", WALL_CLOCK), _req("value", INT), _req("CID"),
        ),
        key=("code",),
        foreign=(ForeignKey("CID", "customer", "ID"),),
        checks={"value_positive": "value > 0"},
    ),
    "category": Contract(
        columns=(_req("ID"), _text("name", 100, True), _req("RID")),
        key=("ID",),
        foreign=(ForeignKey("RID", "restaurant", "ID"),),
        generated_key=True,
    ),
    "food_item": Contract(
        columns=(
            _req("ID"), _text("name", 255, True), _req("price", INT), _text("image", 256),
            _req("categoryID"),
        ),
        key=("ID",),
        foreign=(ForeignKey("categoryID", "category", "ID"),),
        checks={"price_positive": "price > 0"},
        generated_key=True,
    ),
    "food_deliver": Contract(
        columns=(
            _req("ID"), _text("phone_number", 20, True), _text("vehicle_number", 50, True),
            _text("name", 255, True),
        ),
        key=("ID",),
        unique=(("phone_number",), ("vehicle_number",)),
        generated_key=True,
    ),
    "food_order": Contract(
        columns=(
            _req("ID"),
            Col("Payment_method", TEXT, domain=("CARD", "CASH")),
            _text("address", 255, True),
            Col("order_status", TEXT, domain=("pending", "confirmed", "delivered", "cancelled"),
                default="pending"),
            _req("order_time_stamp", AT), Col("review", TEXT), Col("rating", INT),
            _req("orderCost", LONG, default=0),
            Col("ship_status", TEXT, domain=("delivering", "delivered")),
            Col("get_status", TEXT, domain=("in_process", "finished", "cancelled")),
            _req("delivery_fee", INT), _req("CID"), _req("RID"), _req("FDID"),
        ),
        key=("ID",),
        foreign=(
            ForeignKey("CID", "customer", "ID"),
            ForeignKey("RID", "restaurant", "ID"),
            ForeignKey("FDID", "food_deliver", "ID"),
        ),
        checks={
            "rating_one_to_five": "rating >= 1 AND rating <= 5",
            "delivery_fee_not_negative": "delivery_fee >= 0",
        },
        generated_key=True,
    ),
    "use": Contract(
        columns=(_req("CID"), _text("DFRcode", 100, True)),
        key=("CID", "DFRcode"),
        foreign=(
            ForeignKey("CID", "customer", "ID"),
            ForeignKey("DFRcode", "discount_from_restaurant", "code"),
        ),
    ),
    "contain": Contract(
        columns=(_req("FOID"), _req("FIID"), _req("quantity", INT)),
        key=("FOID", "FIID"),
        foreign=(
            ForeignKey("FOID", "food_order", "ID"),
            ForeignKey("FIID", "food_item", "ID"),
        ),
        checks={"quantity_positive": "quantity > 0"},
    ),
    "apply_for": Contract(
        columns=(_text("DFRcode", 100, True), _req("FOID")),
        key=("DFRcode", "FOID"),
        foreign=(
            ForeignKey("DFRcode", "discount_from_restaurant", "code"),
            ForeignKey("FOID", "food_order", "ID"),
        ),
    ),
    "discount_point_apply_for": Contract(
        columns=(_text("DFEPcode", 100, True), _req("FOID")),
        key=("DFEPcode", "FOID"),
        foreign=(
            ForeignKey("DFEPcode", "discount_from_exchange_point", "code"),
            ForeignKey("FOID", "food_order", "ID"),
        ),
    ),
}
