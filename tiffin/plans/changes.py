"""Change sets: many requests applied to the tables in one job.

A request frame has a unique integer ``seq``, the order in which the requests
count.  Each function returns the new table(s) and the rejects, which are the
refused requests with ``error``, the message of the first rule they break.  The
source system stops at the first failure; here good rows go through.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.contracts import TABLES
from tiffin.functions import rules
from tiffin.operators.quality import exists_in, find_duplicates, length_rules, narrow
from tiffin.operators.sequential import first_come
from tiffin.operators.skew import first_per_key, spread_join
from tiffin.plans.cascade import CascadeResult, Stage, cascade_delete
from tiffin.plans.reports import resolve_category
from tiffin.session import durable
from tiffin.sources.loading import apply_defaults, assign_ids, next_id

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Change:
    table: DataFrame
    rejects: DataFrame


@dataclass(frozen=True)
class Deletion:
    cascade: CascadeResult
    rejects: DataFrame


def _split(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    accepted = judged.filter(F.col("error").isNull())
    return accepted, judged.filter(F.col("error").isNotNull()).select(*columns, "error")


def _too_long(table: str, *columns: str) -> list[tuple[Column, str]]:
    """The contract's length rules for the columns a request fills."""
    return [(violated, name) for name, violated, _ in length_rules(TABLES[table])
            if name.removeprefix("length_") in columns]


def _fits(table: str, *columns: str) -> Column:
    out = F.lit(True)
    for violated, _ in _too_long(table, *columns):
        out = out & ~F.coalesce(violated, F.lit(False))
    return out


def _missing(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def judge_new_items(requests: DataFrame, items: DataFrame, categories: DataFrame,
                    refuse_duplicates: bool = False) -> DataFrame:
    """``requests`` with ``error``: blank name, price, category, and before them duplicates if asked.

    Last come the columns' lengths.  Apart from the image's length these rules depend
    on name, price and category alone, so all requests for one item pass or fail them
    together and the first one whose image fits is the one added.
    """
    ladder = rules.first_error(
        (rules.empty(F.col("name")), rules.MSG_ITEM_BLANK),
        (rules.not_positive(F.col("price")), rules.MSG_PRICE),
        (~F.col("_category"), rules.MSG_NEW_CATEGORY),
        (_missing("name", "price", "categoryID"), rules.MSG_REQUIRED),
        *_too_long("food_item", "name", "image"))
    if refuse_duplicates:
        again = F.lit(rules.MSG_DUPLICATE_ITEM)
        ladder = F.coalesce(F.when(F.col("stored"), again), ladder, F.when(F.col("repeated"), again))
        requests = find_duplicates(requests, items, ["name", "price", "categoryID"],
                                   counting=_fits("food_item", "image"))
    return (exists_in(requests, categories, {"categoryID": "ID"}, "_category", unique=True)
            .withColumn("error", ladder)
            .drop("_category", "stored", "repeated"))


def add_items(items: DataFrame, categories: DataFrame, requests: DataFrame,
              refuse_duplicates: bool = False, stage: Stage = lambda df: df) -> Change:
    """Add ``requests (seq, name, price, image, categoryID)`` under new ids in ``seq`` order."""
    judged = stage(judge_new_items(requests, items, categories, refuse_duplicates))
    accepted, rejects = _split(judged, requests.columns)
    added = assign_ids(accepted, next_id(items), "seq")
    return Change(items.unionByName(added.select(*items.columns)), rejects)


def add_items_by_name(items: DataFrame, categories: DataFrame, restaurants: DataFrame,
                      requests: DataFrame, stage: Stage = lambda df: df) -> Change:
    """Add ``requests (seq, name, price, restaurant, category)``: names are resolved, duplicates
    refused, and the image is empty."""
    resolved = stage(resolve_category(requests, categories, restaurants).withColumn("image", F.lit("")))
    unknown = resolved.filter(F.col("categoryID").isNull())
    change = add_items(items, categories, resolved.filter(F.col("categoryID").isNotNull()), True, stage)
    lost = unknown.select(*requests.columns, F.lit(rules.MSG_CATEGORY_NAME).alias("error"))
    return Change(change.table, change.rejects.select(*requests.columns, "error").unionByName(lost))


def update_items(items: DataFrame, categories: DataFrame, requests: DataFrame,
                 stage: Stage = lambda df: df) -> Change:
    """Replace the items named by ``requests (seq, ID, name, price, image, categoryID)``.

    Only existence and price are tested: a blank name and a move to another
    restaurant's category are allowed.  Of several accepted requests for one
    item the last one stands.
    """
    known = exists_in(requests, items, {"ID": "ID"}, "_item", unique=True)
    known = exists_in(known, categories, {"categoryID": "ID"}, "_category", unique=True)
    judged = stage(known.withColumn("error", rules.first_error(
        (~F.col("_item"), rules.MSG_UPDATE_ITEM),
        (rules.not_positive(F.col("price")), rules.MSG_PRICE),
        (~F.col("_category"), rules.MSG_CATEGORY),
        (_missing("name", "price"), rules.MSG_REQUIRED),
        *_too_long("food_item", "name", "image"))).drop("_item", "_category"))
    accepted, rejects = _split(judged, requests.columns)
    values = [c for c in items.columns if c != "ID"]
    last = accepted.groupBy("ID").agg(F.max_by(F.struct(*values), "seq").alias("_new"))
    table = (items.join(last, "ID", "left")
             .select("ID", *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}"))
                             .cast(items.schema[c].dataType).alias(c) for c in values])
             .select(*items.columns))
    return Change(table, rejects)


def update_items_by_name(items: DataFrame, categories: DataFrame, restaurants: DataFrame,
                         requests: DataFrame, stage: Stage = lambda df: df) -> Change:
    """As ``update_items`` with restaurant and category given by name; the image is emptied."""
    resolved = stage(resolve_category(requests, categories, restaurants).withColumn("image", F.lit("")))
    unknown = resolved.filter(F.col("categoryID").isNull())
    change = update_items(items, categories, resolved.filter(F.col("categoryID").isNotNull()), stage)
    lost = unknown.select(*requests.columns, F.lit(rules.MSG_CATEGORY_NAME).alias("error"))
    return Change(change.table, change.rejects.select(*requests.columns, "error").unionByName(lost))


def _judge_deletes(requests: DataFrame, table: DataFrame, message: str) -> DataFrame:
    """A row that is not there, or was deleted by an earlier request, cannot be deleted."""
    first = first_per_key(requests, ["ID"], "seq", "_first")
    known = exists_in(requests, table, {"ID": "ID"}, "_there", unique=True)
    return (spread_join(known, first, ["ID"], "left", ["seq"], counted="n")
            .withColumn("error", F.when(
                ~F.col("_there") | F.coalesce(F.col("seq") > F.col("_first"), F.lit(False)), F.lit(message)))
            .drop("_there", "_first"))


def delete_items(t: Tables, requests: DataFrame, stage: Stage = lambda df: df) -> Deletion:
    """Delete items ``(seq, ID)`` and the order lines that hold them; order costs stay as they are."""
    judged = stage(_judge_deletes(requests, t["food_item"], rules.MSG_DELETE_ITEM))
    accepted, rejects = _split(judged, requests.columns)
    return Deletion(cascade_delete(t, "food_item", accepted.select("ID"), stage), rejects)


def delete_orders(t: Tables, requests: DataFrame, stage: Stage = lambda df: df) -> Deletion:
    """Delete orders ``(seq, ID)`` with lines and applications; usage counts stay as they are."""
    judged = stage(_judge_deletes(requests, t["food_order"], rules.MSG_ORDER))
    accepted, rejects = _split(judged, requests.columns)
    return Deletion(cascade_delete(t, "food_order", accepted.select("ID"), stage), rejects)


def judge_new_accounts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """``requests (seq, username, password)`` with ``error``: name taken, then password too short.

    A name is also taken once an earlier accepted request of the batch got it.
    """
    short = rules.short_password(F.col("password"))
    absent = _missing("username", "password")
    sound = ~F.coalesce(short, F.lit(False)) & ~absent & _fits("account", "username", "password")
    judged = find_duplicates(requests, accounts, ["username"], counting=sound)
    return judged.withColumn("error", rules.first_error(
        (F.col("stored") | F.col("repeated"), rules.MSG_USERNAME_TAKEN),
        (short, rules.MSG_PASSWORD),
        (absent, rules.MSG_REQUIRED),
        *_too_long("account", "username", "password"))).drop("stored", "repeated")


def add_accounts(accounts: DataFrame, requests: DataFrame, stage: Stage = lambda df: df) -> Change:
    """Register accounts under new ids in ``seq`` order."""
    accepted, rejects = _split(stage(judge_new_accounts(requests, accounts)), requests.columns)
    added = assign_ids(accepted, next_id(accounts), "seq")
    return Change(accounts.unionByName(added.select(*accounts.columns)), rejects)


CUSTOMER_COLUMNS = ("name", "email", "phone_number", "address", "birthdate", "card_number", "bank_name")


def judge_new_customers(requests: DataFrame, customers: DataFrame, accounts: DataFrame) -> DataFrame:
    """``requests (seq, username, name, email, ...)`` with the account's ``ID`` and ``error``.

    After the account, e-mail, phone and required-column rules the unique keys
    are given out first come, first served: a customer per account, a phone
    number and a card number each once.
    """
    asked = requests.dropna(subset=["username"]).groupBy("username").agg(F.count(F.lit(1)).alias("_n"))
    facts = asked.join(narrow(accounts.select("username", "ID"), asked, ["username"]), "username", "left")
    found = spread_join(requests, facts, ["username"], "left", ["seq"], counted="_n")
    judged = durable(found.withColumn("error", rules.first_error(
        (F.col("ID").isNull(), rules.MSG_NO_USERNAME),
        (rules.bad_email(F.col("email")), rules.MSG_EMAIL),
        (rules.bad_phone(F.col("phone_number")), rules.MSG_PHONE),
        (_missing("name", "phone_number", "address", "birthdate", "card_number"), rules.MSG_REQUIRED),
        *_too_long("customer", *CUSTOMER_COLUMNS))))
    sound = judged.filter(F.col("error").isNull()).drop("error")
    settled = first_come(sound, customers, [["ID"], ["phone_number"], ["card_number"]])
    refused = F.when(F.col("conflict").isNotNull(), F.lit(rules.MSG_KEY))
    return (settled.withColumn("error", refused).drop("conflict")
            .unionByName(judged.filter(F.col("error").isNotNull())))


def add_customers(customers: DataFrame, accounts: DataFrame, requests: DataFrame) -> Change:
    """Register customers for existing accounts; they start without exchange points."""
    accepted, rejects = _split(judge_new_customers(requests, customers, accounts), requests.columns)
    added = apply_defaults(accepted.select("ID", *CUSTOMER_COLUMNS), "customer")
    return Change(customers.unionByName(added.select(*customers.columns)), rejects)


def delete_accounts(t: Tables, requests: DataFrame, stage: Stage = lambda df: df) -> Deletion:
    """Delete accounts by ``(seq, username, password)`` with all that belongs to them.

    Name and password must match one account; the account of a restaurant that
    still offers discounts cannot go.
    """
    accounts = t["account"]
    pair = ["username", "password"]
    # usernames are unique, so a matching pair stands for one account
    first = first_per_key(requests, pair, "seq", "_first")
    facts = first.join(narrow(accounts.select("ID", *pair), first, pair), pair, "left")
    judged = stage(spread_join(requests, facts, pair, "left", ["seq"], counted="n").withColumn(
        "error", F.when(F.col("ID").isNull() | (F.col("seq") > F.col("_first")), F.lit(rules.MSG_LOGIN))))
    accepted, rejects = _split(judged, requests.columns)
    result = cascade_delete(t, "account", accepted.select("ID"), stage)
    blocked = (judged.join(result.blocked, "ID", "left_semi")
               .select(*requests.columns, F.lit(rules.MSG_RESTRICTED).alias("error")))
    kept_rejects = judged.join(result.blocked, "ID", "left_anti").filter(F.col("error").isNotNull())
    return Deletion(result, kept_rejects.select(*requests.columns, "error").unionByName(blocked))


def retire_discounts(t: Tables, orders: DataFrame | None = None,
                     stage: Stage = lambda df: df) -> CascadeResult:
    """Delete the restaurant discounts applied to ``orders (FOID)`` (default: to any order) that are used up.

    Used up means ``used_Count + 1 >= usageLimit``, so one use before the limit;
    a discount without a limit stays.
    """
    applied = t["apply_for"]
    if orders is not None:
        applied = narrow(applied, orders, ["FOID"])
    used_up = t["discount_from_restaurant"].filter(F.col("used_Count") + 1 >= F.col("usageLimit"))
    codes = narrow(used_up, applied.select(F.col("DFRcode").alias("code")), ["code"]).select("code")
    return cascade_delete(t, "discount_from_restaurant", codes, stage)
