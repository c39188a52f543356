"""Table layouts and the few constants every module shares."""

from pyspark.sql import types as T

HISTORY = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("hist_id", T.LongType()),
        T.StructField("cmd", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("ppid", T.LongType()),
        T.StructField("pwd", T.StringType()),
        T.StructField("salt", T.LongType()),
    ]
)

#: The event table as it is stored; ``day`` partitions it.
STORED = T.StructType(
    [
        *HISTORY.fields,
        T.StructField("row_hash", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)

#: One logged event before the table has given it an id.
EVENT = T.StructType([f for f in HISTORY if f.name != "id"])

#: Cells of a legacy table as text, each with the storage class it was held in.
RAW = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("src_ord", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("cmd", T.StringType()),
        T.StructField("pwd", T.StringType()),
    ]
    + [
        T.StructField(f"{name}_{part}", T.StringType())
        for name in ("hist_id", "epoch", "ppid", "salt")
        for part in ("txt", "type")
    ]
)

VARIABLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("required", T.BooleanType()),
        T.StructField("default", T.StringType()),
    ]
)

TEMPLATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("variables", T.ArrayType(VARIABLE)),
        T.StructField("defaults", T.MapType(T.StringType(), T.StringType())),
    ]
)

DAY_SECONDS = 86_400
#: Seconds at the start of year 0 and at the end of year 9999 (UTC).
MIN_EPOCH = -62_167_219_200
MAX_EPOCH = 253_402_300_799
#: Entries without a time count down from here.
SYNTHETIC_EPOCH = 1_000_000_000
#: Two events of one session belong together when they are less than this apart.
WINDOW_SECONDS = 3_600
#: Ids per numbered chunk; no window in this package sees more rows than this.
CHUNK = 1 << 20
