"""Explicit input schemas; readers never infer."""

from __future__ import annotations

_OPTION = (
    "struct<name:string,description:string,required:boolean,type:string,"
    "default:string,example:string>"
)

RAW_TOOL = f"""
tool_id string, tool_name string, description string, official_site_url string, website string,
version string, tool_version string, license string, licence string,
installation_instructions string, installation_details string, install_instructions string,
usage_summary string, common_use_cases string, usage string,
categories string, tags array<string>, supported_os array<string>,
authors_maintainers string, source_code_url string, binary_download_url string,
logo_url string, data_sensitivity_level string, encryption_key_id string,
first_seen_timestamp string, last_updated_timestamp string,
source_url string, parser_plugin_name string, parser_hint string, content string,
related_vulnerabilities array<string>,
commands array<struct<name:string,description:string,syntax:string,options:array<{_OPTION}>,examples:array<string>>>,
modules array<struct<name:string,type:string,description:string,options:array<{_OPTION}>,examples:array<string>>>,
practical_examples array<string>,
workflows array<struct<name:string,steps:array<string>>>,
troubleshooting array<struct<issue:string,solution:string>>,
link_strings array<string>,
external_links array<struct<link:string,url:string,title:string,parent_id:string>>
"""

KNOWLEDGE = (
    "id string, title string, content string, source string, type string, url string, "
    "timestamp timestamp_ntz, encrypted boolean"
)

SCAN = (
    "id string, target string, scan_type string, ports string, status string, "
    "start_time timestamp_ntz, end_time timestamp_ntz, results string"
)

TRAINING_HISTORY = (
    "id string, model_type string, training_data string, start_date timestamp_ntz, "
    "end_date timestamp_ntz, status string, accuracy double"
)

SETTINGS = "key string, value string, encrypted boolean"

CVE_ENTRY = (
    "cve_id string, description string, severity string, affected_os string, published string"
)

SCAN_HOST_XML = (
    "status struct<_state:string>, "
    "address array<struct<_addr:string,_addrtype:string>>, "
    "ports struct<port:array<struct<_portid:int,_protocol:string,state:struct<_state:string>,"
    "service:struct<_name:string,_version:string,_product:string>>>>"
)

ACTIVITY = (
    "timestamp timestamp_ntz, event_type string, severity string, message string, "
    "job_id string, username string, data string"
)

PAGE_SNAPSHOT = "page_id bigint, url string, html string"
