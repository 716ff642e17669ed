"""Schemas of the fact tables, in one place; no reader infers one."""

from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    out = T.StructType()
    for part in ddl.split(";"):
        name, kind = part.strip().split(" ", 1)
        out.add(name, {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}[kind])
    return out


#: Columns of the point table, in file order.
IO_POINTS = _s(
    "id string; mnemonic string; signal_name string; customer_tag string; functional_group string; io_category string; "
    "physical_type string; data_type string; hw_address string; plc_address string; is_safety boolean; circuit_ref string; "
    "control_unit string; control_light string; is_intrinsically_safe boolean; xml_source string"
)
TAGS = _s("name string; address string; data_type string; comment string; category string; direction string; source_file string")
ACCESSES = _s("block_name string; path string; kind string; line int; statement string; element string")
DB_REFS = _s("block_name string; db_name string; field_path string; full_reference string; line_number int; is_write boolean")
CALLS = _s("caller string; callee string; instance_name string; call_type string; line_number int")
SAMPLES = _s("node string; ts timestamp; value double; status_code int")
PACKETS = _s(
    "ts timestamp; src string; dst string; l4 string; sport int; dport int; size int; flags int; seq long; icmp_type int; payload binary"
)
VIOLATIONS = _s("rule_code string; severity string; subject string; message string; line int")
TOKENS = _s("block string; seq int; type string; value string; line int; column int")
