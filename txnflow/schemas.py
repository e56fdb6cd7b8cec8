"""Column roles and input schemas.

Schemas are DDL strings: Spark accepts them wherever it accepts a ``StructType``, and a string cannot be
changed by a caller the way a shared ``StructType`` can.
"""

# Names, order and types of the stored tables and of the messages.
CUSTOMER = (
    "cc_num string, first string, last string, gender string, street string, city string, "
    "state string, zip string, lat double, long double, job string, dob timestamp"
)
TRANSACTION = (
    "cc_num string, first string, last string, trans_num string, trans_date string, trans_time string, "
    "unix_time bigint, category string, merchant string, amt double, merch_lat double, merch_long double"
)
LABELLED_TRANSACTION = TRANSACTION + ", is_fraud double"
# Numbers arrive as text in the messages; they and the time are cast after parsing, one bad field at a time.
TRANSACTION_MESSAGE = (
    "cc_num string, first string, last string, trans_num string, trans_time string, category string, "
    "merchant string, amt string, merch_lat string, merch_long string"
)
OFFSETS = "partition int, offset bigint"
POINT_MESSAGE = "x double, y double, z string"
TOPIC = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"

#: Where a message stands.
POSITION = ["topic", "partition", "offset"]

LABEL = "is_fraud"
ENRICHED = [
    "cc_num", "trans_time", "trans_num", "category", "merchant",
    "amt", "merch_lat", "merch_long", "distance", "age",
]
FEATURES = ["cc_num", "category", "merchant", "distance", "amt", "age"]
FRAUD, NON_FRAUD = "fraud", "non_fraud"

# Primary keys of the keyed tables, and the columns that decide between rows of equal key.
TRANSACTION_KEY = ["cc_num", "trans_time"]
TRANSACTION_TIES = ["trans_num", "amt"]
CUSTOMER_KEY = ["cc_num"]
OFFSETS_KEY = ["partition"]
