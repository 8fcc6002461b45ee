"""Column expressions over tag=value messages. All of them stay inside Catalyst; none needs a shuffle.

A message is a string of fields `tag=value`, each ended by SOH. Its tokenised form is an array of
struct<pos, tag, value>, in message order; `pos` counts fragments from 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOH = "\x01"
#: A message runs from `8=FIX` to the first three-digit field 10; `.` matches all but a line feed.
MESSAGE = r"(?d)8=FIX.*?10=[0-9]{3}\x01"
#: The same, where field 10 must follow a separator, so that 110=100 doesn't end a message.
ANCHORED = r"(?d)8=FIX.*?\x0110=[0-9]{3}\x01"
LARGEST_TAG = 4294967295

FIELD = "struct<pos:int,tag:bigint,value:string>"


def messages(line: Column, anchored: bool = False) -> Column:
    """array<string> of the messages in a line; the substring test spares most lines the expression."""
    found = F.regexp_extract_all(line, F.lit(ANCHORED if anchored else MESSAGE), F.lit(0))
    return F.when(F.contains(line, F.lit("8=FIX")), found).otherwise(F.array().cast("array<string>"))


def fields(raw: Column) -> Column:
    """array<struct<pos, tag, value>>; fragments without `=` or with a tag that is no 32-bit number are dropped."""

    def field(fragment: Column, i: Column) -> Column:
        eq = F.instr(fragment, "=")
        text = F.substr(fragment, F.lit(1), eq - 1)
        tag = F.when((eq > 1) & text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
        return F.struct((i + 1).cast("int").alias("pos"), tag.alias("tag"), F.substr(fragment, eq + 1).alias("value"))

    split = F.transform(F.split(raw, SOH), field)
    kept = F.filter(split, lambda f: f["tag"].isNotNull() & (f["tag"] <= LARGEST_TAG))
    return F.when(F.contains(raw, F.lit(SOH)), kept).otherwise(F.array().cast(f"array<{FIELD}>"))


def first_value(found: Column, tag: int) -> Column:
    """The first field with the tag counts: message type, version and session keys."""
    return F.get(F.filter(found, lambda f: f["tag"] == tag), F.lit(0))["value"]


def last_value(found: Column, tag: int) -> Column:
    """The last field with the tag counts: validation and order state."""
    return F.try_element_at(F.filter(found, lambda f: f["tag"] == tag), F.lit(-1))["value"]


def tag_map(found: Column) -> Column:
    """map<tag, value>, last one wins (spark.sql.mapKeyDedupPolicy=LAST_WIN)."""
    return F.map_from_entries(F.transform(found, lambda f: F.struct(f["tag"], f["value"])))


def raw_value(raw: Column, tag: int) -> Column:
    """The first value of a tag straight from the text, without tokenising; null if there is none."""
    text = F.concat(F.lit(SOH), raw)
    return F.when(text.rlike(rf"\x01{tag}="), F.regexp_extract(text, rf"\x01{tag}=([^\x01]*)", 1))


def byte_sum(text: Column) -> Column:
    """The sum of the UTF-8 bytes; texts of one byte a character take the fast way."""
    narrow = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.ascii(c))
    digits = F.hex(F.encode(text, "UTF-8"))
    wide = F.aggregate(F.sequence(F.lit(0), F.octet_length(text) - 1), F.lit(0).cast("bigint"), lambda s, i: s + F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.octet_length(text) == 0, F.lit(0).cast("bigint")).when(F.octet_length(text) == F.length(text), narrow).otherwise(wide)


def checksum(raw: Column) -> Column:
    """Bytes up to the separator before the last field 10, modulo 256, three digits; null without field 10."""
    before = F.regexp_extract(raw, r"(?s)^(.*\x01)10=", 1)
    return F.when(before != "", F.lpad((byte_sum(before) % 256).cast("string"), 3, "0"))


def checksum_error(raw: Column, found: Column) -> Column:
    """Null, or what is wrong with field 10, which is compared as text."""
    declared, actual = last_value(found, 10), checksum(raw)
    return F.when(declared.isNull(), "checksum missing").when(actual.isNull() | (declared != actual), F.concat(F.lit("checksum mismatch: declared "), declared, F.lit(", computed "), F.coalesce(actual, F.lit("-1"))))


_LENGTH = r"(?s)^.*?9=[^\x01]*(\x01.*)?\x0110="


def body_length(raw: Column) -> Column:
    """Bytes after the separator that ends the first `9=`, through the one before the last field 10; null
    where either is missing. The separator that the group takes in front stands for the one behind."""
    return F.when(raw.rlike(_LENGTH), F.octet_length(F.regexp_extract(raw, _LENGTH, 1)).cast("bigint"))


def body_length_error(raw: Column, found: Column) -> Column:
    """Null, or what is wrong with field 9, which is compared as a number."""
    declared, actual = last_value(found, 9), body_length(raw)
    number = F.when(declared.rlike(r"^\+?[0-9]+$"), declared.try_cast("bigint"))
    return (
        F.when(declared.isNull(), "body length missing")
        .when(number.isNull(), F.concat(F.lit("body length not a number: "), declared))
        .when(actual.isNull(), "body length can't be computed")
        .when(number != actual, F.concat(F.lit("body length mismatch: declared "), number.cast("string"), F.lit(", computed "), actual.cast("string")))
    )


def shown(raw: Column, delimiter: str) -> Column:
    """The message with another delimiter."""
    return F.replace(raw, F.lit(SOH), F.lit(delimiter))


#: Names of field types and their rules; types that aren't listed allow everything.
INTEGERS = ("INT", "LENGTH", "NUMINGROUP", "SEQNUM", "DAYOFMONTH")
DECIMALS = ("FLOAT", "QTY", "PRICE", "PRICEOFFSET", "AMT", "PERCENTAGE")
_DECIMAL = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_TIME = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{3})?)?$"
_MONTH_YEAR = r"^[0-9]{6}(?:[0-9]{2}|-[0-9]{1,2}|-?w[1-5])?$"


def type_allows(kind: Column, value: Column) -> Column:
    """Whether a value is of the dictionary type named."""
    k = F.upper(kind)
    return (
        F.when(k.isin(*INTEGERS), value.rlike(r"^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull())
        .when(k.isin(*DECIMALS), value.rlike(_DECIMAL))
        .when(k == "BOOLEAN", value.isin("Y", "N"))
        .when(k == "CHAR", F.length(value) == 1)
        .when(k == "UTCTIMESTAMP", value.rlike(r"^[0-9]{8}-[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?$") & F.try_to_timestamp(F.substring(value, 1, 17), F.lit("yyyyMMdd-HH:mm:ss")).isNotNull())
        .when(k == "UTCDATEONLY", value.rlike(r"^[0-9]{8}$") & F.try_to_date(value, "yyyyMMdd").isNotNull())
        .when(k == "UTCTIMEONLY", value.rlike(_TIME))
        .when(k == "MONTHYEAR", value.rlike(_MONTH_YEAR))
        .otherwise(F.lit(True))
    )


def sentence(description: Column) -> Column:
    """An enum's description with only its first letter in upper case."""
    return F.concat(F.upper(F.substring(description, 1, 1)), F.lower(F.substr(description, F.lit(2))))


def enum_label(description: Column, code: Column) -> Column:
    return F.format_string("%s (%s)", sentence(description), code)


def group_title(name: Column) -> Column:
    """A count field's name without its leading `No`."""
    return F.regexp_replace(name, "^No(?=[A-Z])", "")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def date_part(timestamp: Column) -> Column:
    """The eight digits a timestamp begins with; null if it doesn't."""
    return F.when(timestamp.rlike("^[0-9]{8}"), F.substring(timestamp, 1, 8))


def business_days(trade: Column, settle: Column) -> Column:
    """Week days after `trade` through `settle` (yyyyMMdd); null if a date is bad or settle comes first."""
    t, s = F.try_to_date(trade, "yyyyMMdd"), F.try_to_date(settle, "yyyyMMdd")
    days = F.size(F.filter(F.sequence(F.date_add(t, 1), F.greatest(s, F.date_add(t, 1))), lambda d: F.weekday(d) < 5))
    return F.when(s == t, F.lit(0)).when(s > t, days)


def tenor(days: Column) -> Column:
    return F.when(days == 0, "TOD").when(days == 1, "TOM").when(days == 2, "SPOT").when(days > 2, "FWD")


#: Order status (39), execution type (150), acknowledgement (1036) and side (54).
ORDER_STATUS = {"A": "Pending New", "0": "New", "1": "Partially Filled", "2": "Filled", "3": "Done for Day", "4": "Canceled", "5": "Replaced", "6": "Pending Cancel", "7": "Stopped", "8": "Rejected", "9": "Suspended", "B": "Calculated", "C": "Expired", "D": "Accepted for Bidding", "E": "Pending Replace"}
EXEC_TYPE = {k: v for k, v in ORDER_STATUS.items() if k not in "BD"} | {"F": "Trade", "G": "Trade Correct", "H": "Trade Cancel", "I": "Order Status"}
EXEC_ACK = {"0": "Received", "1": "Accepted", "2": "Dont Know", "3": "Rejected", "4": "Accepted With Errors"}
SIDE = {"1": "Buy", "2": "Sell", "5": "SellShort", "6": "SellShortExempt", "8": "Cross"}
TERMINAL_STATES = ("Filled", "Canceled", "Rejected", "Done for Day", "Expired", "Stopped", "Suspended", "Calculated")
TERMINAL_ACKS = ("1", "3", "4")


def label(labels: dict[str, str], code: Column, default: Column | None = None) -> Column:
    """The label of a code, or the default."""
    out = None
    for k, v in labels.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(default) if default is not None else out


def side_label(code: Column) -> Column:
    return label(SIDE, code, F.lit("Side?"))


def order_state(status: Column, exec_type: Column, ack: Column, leaves: Column) -> Column:
    """Order status, else execution type, else acknowledgement, else nothing left, else unknown."""
    return F.coalesce(label(ORDER_STATUS, status), label(EXEC_TYPE, exec_type), label(EXEC_ACK, ack), F.when(leaves == "0", "Filled"), F.lit("Unknown"))


def price_with_currency(price: Column, currency: Column) -> Column:
    return F.when(price.isNull(), None).when(currency.isNull() | (currency == ""), price).otherwise(F.concat_ws(" ", price, currency))


def parse_delimiter(text: str) -> str:
    """A display delimiter: SOH, \\xNN, 0xNN or one character."""
    if text.upper() == "SOH":
        return SOH
    if text[:2].lower() in ("\\x", "0x") and len(text) == 4:
        return chr(int(text[2:], 16))
    if len(text) == 1:
        return text
    raise ValueError(f"not a delimiter: {text!r}")
