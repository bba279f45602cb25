"""The calls table: one row for each JSON-RPC call; the calls of a batch share flow_id and repeat the flow's columns."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType()}
# Names and types of the columns, in order.
CALLS_COLUMNS = (
    ("flow_id", "long"), ("position", "int"), ("batch_size", "int"), ("ts_start", "double"), ("duration_ms", "double"), ("http_status", "int"),
    ("host", "string"), ("path", "string"), ("method", "string"), ("rpc_id", "string"), ("params_json", "string"), ("result_json", "string"),
    ("error_code", "long"), ("error_message", "string"), ("error_data_json", "string"), ("flow_req_bytes", "long"), ("flow_resp_bytes", "long"),
)
CALLS_SCHEMA = StructType([StructField(n, _TYPES[t]) for n, t in CALLS_COLUMNS])
