"""Row rules and the messages a failed rule reports.

Every rule is written as a *violation*: a Column that is true when the row must
be refused.  A NULL input makes the comparison NULL, which is not true, so it
passes; required columns are checked separately.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, lengths and messages that results must agree on.
EMAIL = r"^[a-zA-Z0-9][+a-zA-Z0-9._-]*@[a-zA-Z0-9][a-zA-Z0-9]*\.[a-zA-Z]{2,4}$"
PHONE = r"^0[0-9]{9}$"
PHONE_OCTETS = 10
PASSWORD_OCTETS = 8
RESTAURANT_NAME = r"^[\p{L} ]+$"
# " -." is a range: every character from the space to the full stop is allowed
ITEM_NAME = r"^[\p{L}0-9À-ÿ -.,()]+$"

MSG_ITEM_RESTAURANT = "Food item does not belong to the same restaurant as the food order."
MSG_DISCOUNT_CAP = "The discount exceeds 30% of the total food order price."
MSG_COMBINED_CAP = "The total discount exceeds 30% of the total food order price."
MSG_ITEM_BLANK = "The food name field cannot be blank"
MSG_PRICE = "The food price must be greater 0"
MSG_NEW_CATEGORY = "The new category has not been added"
MSG_DELETE_ITEM = "The food item does not exist"
MSG_UPDATE_ITEM = "The food item does not exists"
MSG_CATEGORY = "The category does not exist"
MSG_CATEGORY_NAME = "Category not found."
MSG_DUPLICATE_ITEM = "Already add this food item"
MSG_ORDER = "Order not found"
MSG_USERNAME_TAKEN = "Tên đăng nhập đã tồn tại"
MSG_PASSWORD = "Vui lòng nhập mật khẩu ít nhất 8 kí tự"
MSG_NO_USERNAME = "Customer does not have an username"
MSG_EMAIL = "Invalid Email address"
MSG_PHONE = "Invalid phone number (must have 10 number digits)"
MSG_LOGIN = "Tên đăng nhập không tồn tại"
MSG_CATEGORY_ID = "Category ID must be positive"
MSG_RESTAURANT_NAME = "Wrong restaurant format name!"
MSG_RESTAURANT = "Restaurant does not exist!"
MSG_ITEM_NAME = "Invalid food name"
MSG_ITEM_OF_RESTAURANT = "Food item does not exist in the restaurant!"

# Messages of our own, for refusals that the source system leaves to its database.
MSG_REQUIRED = "a required column is missing"
MSG_KEY = "duplicate key"
MSG_REFERENCE = "a referenced row does not exist"
MSG_QUOTA = "the discount has reached its usage limit"
MSG_RESTRICTED = "rows that must not be deleted refer to this one"
MSG_AMBIGUOUS = "more than one food item has this name"


def bad_email(email: Column) -> Column:
    return ~email.rlike(EMAIL)


def bad_phone(phone: Column) -> Column:
    return (F.octet_length(phone) != PHONE_OCTETS) | ~phone.rlike(PHONE)


def short_password(password: Column) -> Column:
    """Length counts bytes, not characters."""
    return F.octet_length(password) < PASSWORD_OCTETS


def empty(text: Column) -> Column:
    """Only the empty string; spaces are a name."""
    return text == ""


def bad_restaurant_name(name: Column) -> Column:
    return ~name.rlike(RESTAURANT_NAME)


def bad_item_name(name: Column) -> Column:
    return ~name.rlike(ITEM_NAME)


def not_positive(number: Column) -> Column:
    return number <= 0


def negative(number: Column) -> Column:
    """Zero is accepted although the message asks for a positive id."""
    return number < 0


def first_error(*ladder: tuple[Column, str]) -> Column:
    """Message of the first violated rule, NULL when none is."""
    return F.coalesce(*[F.when(violated, F.lit(message)) for violated, message in ladder])
