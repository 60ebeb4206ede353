"""Explicit schemas: the nested export request, and the canonical tables."""

#: A value keeps its containers as raw JSON text: Spark types can't recurse. Scalars are text too, so that one of the wrong kind can be told.
ANY = "struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,bytesValue:string,arrayValue:string,kvlistValue:string,stringValueStrindex:string>"
KV = f"struct<key:string,value:{ANY}>"
RECORD = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{ANY},attributes:array<{KV}>,droppedAttributesCount:bigint,flags:bigint,traceId:string,spanId:string,eventName:string>"
SCOPE_LOGS = f"struct<scope:struct<name:string,version:string,attributes:array<{KV}>,droppedAttributesCount:bigint>,schemaUrl:string,logRecords:array<{RECORD}>>"
RESOURCE_LOGS = f"struct<resource:struct<attributes:array<{KV}>,droppedAttributesCount:bigint>,schemaUrl:string,scopeLogs:array<{SCOPE_LOGS}>>"
REQUEST = f"resourceLogs array<{RESOURCE_LOGS}>"

LOG_EVENT = "id bigint, resource_id string, timestamp_ns bigint, observed_timestamp_ns bigint, severity_number int, severity_text string, trace_id binary, span_id binary, body string, event_name string, flags bigint, dropped_attributes_count bigint, scope_name string, scope_version string, attributes_json string, scope_attributes_json string, scope_schema_url string"
LOG_RESOURCE = "id string, service_name string, host_name string, schema_url string, attributes_json string"
SEARCH_STATE = "id int, mode string, status string, last_rowid bigint, rebuild_until bigint"
