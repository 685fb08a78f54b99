"""Schemas of the log types: field names and declared types, and how each type is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of each log type, as ``name:type`` in file order.
_SHARED = "ts:time uid:string id.orig_h:addr id.orig_p:port id.resp_h:addr id.resp_p:port"
FIELDS = {
    "CONN": f"{_SHARED} proto:enum service:string duration:interval orig_bytes:count resp_bytes:count conn_state:string local_orig:bool local_resp:bool missed_bytes:count history:string orig_pkts:count orig_ip_bytes:count resp_pkts:count resp_ip_bytes:count tunnel_parents:set[string]",
    "DNS": f"{_SHARED} proto:enum trans_id:count rtt:interval query:string qclass:count qclass_name:string qtype:count qtype_name:string rcode:count rcode_name:string AA:bool TC:bool RD:bool RA:bool Z:count answers:vector[string] TTLs:vector[interval] rejected:bool",
    "HTTP": f"{_SHARED} trans_depth:count method:string host:string uri:string referrer:string version:string user_agent:string origin:string request_body_len:count response_body_len:count status_code:count status_msg:string info_code:count info_msg:string tags:set[enum] username:string password:string proxied:set[string] orig_fuids:vector[string] orig_filenames:vector[string] orig_mime_types:vector[string] resp_fuids:vector[string] resp_filenames:vector[string] resp_mime_types:vector[string]",
    "SSL": f"{_SHARED} version:string cipher:string curve:string server_name:string resumed:bool last_alert:string next_protocol:string established:bool ssl_history:string cert_chain_fps:vector[string] client_cert_chain_fps:vector[string] sni_matches_cert:bool",
    "WEIRD": f"{_SHARED} name:string addl:string notice:bool peer:string source:string",
}
#: The narrow projections of each log type.
NARROW = {
    "CONN": "ts uid orig_h resp_h proto duration orig_bytes resp_bytes conn_state local_orig local_resp orig_pkts orig_ip_bytes resp_pkts resp_ip_bytes",
    "DNS": "ts uid orig_h resp_h proto rtt query qtype qtype_name rcode rcode_name answers TTLs rejected",
    "HTTP": "ts uid orig_h resp_h method host uri user_agent request_body_len response_body_len status_code status_msg username password orig_filenames orig_mime_types resp_filenames resp_mime_types",
    "SSL": "ts uid orig_h resp_h cipher curve server_name ssl_history",
    "WEIRD": "ts uid orig_h resp_h name addl notice peer source",
}
_SPARK = {"time": "decimal(16,6)", "interval": "double", "double": "double", "count": "bigint", "int": "bigint", "port": "int", "bool": "boolean"}


def column_name(field: str) -> str:
    """``id.orig_h`` -> ``orig_h``; other dots become underscores."""
    return field.removeprefix("id.").replace(".", "_")


def spark_type(kind: str) -> str:
    """The Spark type of a declared type; vectors and sets become arrays."""
    if kind.startswith(("vector[", "set[")):
        return f"array<{spark_type(kind[kind.index('[') + 1 : -1])}>"
    return _SPARK.get(kind, "string")


def fields(log_type: str) -> list[tuple[str, str]]:
    """(field, declared type) of a log type."""
    return [tuple(x.split(":", 1)) for x in FIELDS[log_type].split()]


def width(log_type: str) -> int:
    return len(fields(log_type))


def schema(log_type: str) -> T.StructType:
    """The typed table of a log type."""
    return T.StructType.fromDDL(", ".join(f"`{column_name(n)}` {spark_type(k)}" for n, k in fields(log_type)))


def typed(token: Column, kind: str, unset: str = "-", empty: str = "(empty)", separator: str = ",") -> Column:
    """A token as its type: NULL for the unset mark, an empty list for the empty mark, NULL for what does not parse."""
    value = F.nullif(token, F.lit(unset))
    if kind.startswith(("vector[", "set[")):
        inner = kind[kind.index("[") + 1 : -1]
        items = F.transform(F.split(value, separator), lambda x: typed(x, inner, unset, empty))
        return F.when(value == empty, F.array().cast(spark_type(kind))).otherwise(items if kind[0] == "v" else F.array_distinct(items))
    if kind == "bool":
        return F.when(value == "T", True).when(value == "F", False)
    return value.try_cast(spark_type(kind)) if kind in _SPARK else value
