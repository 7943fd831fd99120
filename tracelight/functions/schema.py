"""The event schema: which fields exist, of what type, which are repeated, and the members of enums.

It is used when a query, rule or parser program is compiled; events themselves are
documents without a fixed shape.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from pathlib import Path

TIMESTAMP = "google.protobuf.Timestamp"
STRUCT = "google.protobuf.Struct"
#: Spark types of scalar types; all others (messages, structs, enums) are text.
KINDS = {
    "string": "string", "bytes": "string", "bool": "boolean", "int32": "bigint", "int64": "bigint", "uint32": "bigint",
    "uint64": "bigint", "float": "double", "double": "double", TIMESTAMP: "timestamp_ntz",
}


@dataclass(frozen=True)
class Field:
    path: str
    type: str = "message"
    repeated: bool = False
    enum: bool = False

    @property
    def kind(self) -> str:
        """The Spark type that values are cast to before they are compared."""
        return "string" if self.enum else KINDS.get(self.type, "string")


# The fields that a grouped name stands for.
GROUPED: dict[str, tuple[str, ...]] = {
    "domain": (
        "about.administrative_domain",
        "about.asset.network_domain",
        "network.dns.questions.name",
        "network.dns_domain",
        "principal.administrative_domain",
        "principal.asset.network_domain",
        "target.administrative_domain",
        "target.asset.hostname",
        "target.asset.network_domain",
        "target.hostname",
    ),
    "email": (
        "intermediary.user.email_addresses",
        "network.email.from",
        "network.email.to",
        "principal.user.email_addresses",
        "security_result.about.user.email_addresses",
        "target.user.email_addresses",
    ),
    "file_path": (
        "principal.file.full_path",
        "principal.process.file.full_path",
        "principal.process.parent_process.file.full_path",
        "target.file.full_path",
        "target.process.file.full_path",
        "target.process.parent_process.file.full_path",
    ),
    "hash": (
        "about.file.md5",
        "about.file.sha1",
        "about.file.sha256",
        "principal.process.file.md5",
        "principal.process.file.sha1",
        "principal.process.file.sha256",
        "security_result.about.file.sha256",
        "target.file.md5",
        "target.file.sha1",
        "target.file.sha256",
        "target.process.file.md5",
        "target.process.file.sha1",
        "target.process.file.sha256",
    ),
    "hostname": (
        "intermediary.hostname",
        "observer.hostname",
        "principal.asset.hostname",
        "principal.hostname",
        "src.asset.hostname",
        "src.hostname",
        "target.asset.hostname",
        "target.hostname",
    ),
    "ip": (
        "intermediary.ip",
        "observer.ip",
        "principal.artifact.ip",
        "principal.asset.ip",
        "principal.ip",
        "src.artifact.ip",
        "src.asset.ip",
        "src.ip",
        "target.artifact.ip",
        "target.asset.ip",
        "target.ip",
    ),
    "namespace": ("principal.namespace", "src.namespace", "target.namespace"),
    "process_id": (
        "principal.process.parent_process.pid",
        "principal.process.parent_process.product_specific_process_id",
        "principal.process.pid",
        "principal.process.product_specific_process_id",
        "target.process.parent_process.pid",
        "target.process.parent_process.product_specific_process_id",
        "target.process.pid",
        "target.process.product_specific_process_id",
    ),
    "user": (
        "about.user.userid",
        "observer.user.userid",
        "principal.user.user_display_name",
        "principal.user.userid",
        "principal.user.windows_sid",
        "src.user.userid",
        "target.user.user_display_name",
        "target.user.userid",
        "target.user.windows_sid",
    ),
}

#: Members of the enums that the built-in fields have.
ENUMS: dict[str, frozenset[str]] = {
    "Metadata.EventType": frozenset(
        """EVENTTYPE_UNSPECIFIED GENERIC_EVENT STATUS_UPDATE
        PROCESS_UNCATEGORIZED PROCESS_LAUNCH PROCESS_TERMINATION PROCESS_INJECTION PROCESS_OPEN PROCESS_MODULE_LOAD
        REGISTRY_CREATION REGISTRY_MODIFICATION REGISTRY_DELETION
        FILE_UNCATEGORIZED FILE_CREATION FILE_DELETION FILE_MODIFICATION FILE_READ FILE_COPY FILE_OPEN FILE_MOVE
        NETWORK_UNCATEGORIZED NETWORK_FLOW NETWORK_CONNECTION NETWORK_FTP NETWORK_DHCP NETWORK_DNS NETWORK_HTTP NETWORK_SMTP
        USER_UNCATEGORIZED USER_LOGIN USER_LOGOUT USER_CREATION USER_DELETION USER_CHANGE_PASSWORD USER_CHANGE_PERMISSIONS
        USER_RESOURCE_ACCESS USER_RESOURCE_CREATION USER_RESOURCE_DELETION USER_RESOURCE_UPDATE_CONTENT USER_RESOURCE_UPDATE_PERMISSIONS
        EMAIL_UNCATEGORIZED EMAIL_TRANSACTION EMAIL_URL_CLICK
        SCAN_UNCATEGORIZED SCAN_FILE SCAN_HOST SCAN_NETWORK SCAN_PROCESS SCAN_VULN_HOST
        SERVICE_START SERVICE_STOP SERVICE_CREATION SERVICE_MODIFICATION SERVICE_DELETION
        SETTING_MODIFICATION RESOURCE_CREATION RESOURCE_DELETION RESOURCE_READ RESOURCE_WRITTEN GROUP_CREATION GROUP_MODIFICATION
        SYSTEM_AUDIT_LOG_WIPE""".split()
    ),
    "Network.IpProtocol": frozenset("UNKNOWN_IP_PROTOCOL ICMP IGMP TCP UDP IP6IN4 GRE ESP ICMP6 EIGRP ETHERIP PIM VRRP SCTP".split()),
    "SecurityResult.Action": frozenset(
        "UNKNOWN_ACTION ALLOW BLOCK ALLOW_WITH_MODIFICATION QUARANTINE FAIL CHALLENGE".split()
    ),
}

#: Fields of a noun (who or what an event is about), ``*`` for repeated; a name without a type is a message.
FILE = "full_path:string md5:string sha1:string sha256:string mime_type:string size:uint64"
PROCESS = f"pid:string product_specific_process_id:string command_line:string file {' '.join('file.' + x for x in FILE.split())}"
NOUN = f"""
    hostname:string ip*:string port:int32 mac*:string namespace:string administrative_domain:string application:string url:string
    platform:string
    user user.userid:string user.user_display_name:string user.windows_sid:string user.email_addresses*:string user.group_identifiers*:string
    asset asset.hostname:string asset.ip*:string asset.mac*:string asset.network_domain:string asset.asset_id:string
    asset.vulnerabilities* asset.vulnerabilities.cvss_base_score:float asset.vulnerabilities.name:string
    artifact artifact.ip:string artifact.network artifact.network.dhcp artifact.network.dhcp.client_hostname:string
    file {' '.join('file.' + x for x in FILE.split())}
    process {' '.join('process.' + x for x in PROCESS.split())}
    process.parent_process {' '.join('process.parent_process.' + x for x in PROCESS.split())}
    resource resource.name:string resource.type:string resource.attribute resource.attribute.labels*
    resource.attribute.labels.key:string resource.attribute.labels.value:string
    location location.city:string location.country_or_region:string
"""
NOUNS = "principal target src observer* intermediary* about* security_result.about*"
OTHERS = f"""
    metadata metadata.id:string metadata.event_type:enum/Metadata.EventType metadata.product_name:string metadata.vendor_name:string
    metadata.product_event_type:string metadata.product_version:string metadata.product_log_id:string metadata.log_type:string
    metadata.description:string metadata.event_timestamp:{TIMESTAMP} metadata.collected_timestamp:{TIMESTAMP}
    metadata.ingested_timestamp:{TIMESTAMP} metadata.ingestion_labels* metadata.ingestion_labels.key:string
    metadata.ingestion_labels.value:string
    network network.dns_domain:string network.ip_protocol:enum/Network.IpProtocol network.application_protocol:string
    network.session_id:string network.sent_bytes:uint64 network.received_bytes:uint64
    network.dns network.dns.response:bool network.dns.questions* network.dns.questions.name:string network.dns.questions.type:uint32
    network.dns.answers* network.dns.answers.name:string network.dns.answers.data:string
    network.http network.http.method:string network.http.user_agent:string network.http.response_code:int32 network.http.referral_url:string
    network.email network.email.from:string network.email.to*:string network.email.subject*:string
    security_result* security_result.action*:enum/SecurityResult.Action security_result.description:string
    security_result.summary:string security_result.severity:string security_result.category_details*:string
    security_result.rule_name:string security_result.rule_id:string security_result.threat_name:string
    extensions extensions.auth extensions.auth.type:string
    additional:{STRUCT}
"""
GRAPH = "graph graph.entity graph.metadata graph.metadata.event_metadata graph.metadata.event_metadata.log_type:string"


def _declared(words: Iterable[str], prefix: str = "") -> Iterable[Field]:
    for word in words:
        name, _, kind = word.partition(":")
        repeated, enum = name.endswith("*"), kind.startswith("enum/")
        yield Field(prefix + name.rstrip("*"), kind.removeprefix("enum/") or "message", repeated, enum)


class Schema:
    """Fields by dotted path. Every prefix of a path is a field itself."""

    def __init__(self, fields: Iterable[Field] = (), enums: dict[str, frozenset[str]] | None = None):
        self.fields = {f.path: f for f in fields}
        self.enums = dict(enums or {})

    def lookup(self, path: str) -> Field | None:
        return self.fields.get(path)

    def enum_values(self, name: str) -> frozenset[str] | None:
        return self.enums.get(name)

    def with_fields(self, *fields: Field) -> Schema:
        """This schema and further fields, for events with extensions of their own."""
        return Schema([*self.fields.values(), *fields], self.enums)

    @classmethod
    def builtin(cls) -> Schema:
        return _builtin()

    @classmethod
    def from_files(cls, fields_csv: str | Path, enums_json: str | Path | None = None) -> Schema:
        """A dictionary with the columns root, path, type, label, enum, and enum members as ``{"enums": {type: [{"name": …}]}}``.

        Rows whose root is ``entity`` are fields under ``graph.`` unless an event row has the same path.
        """
        fields: dict[str, Field] = {}
        with Path(fields_csv).open(newline="", encoding="utf-8") as f:
            for row in csv.DictReader(f):
                graph = row["root"] == "entity"
                if graph or row["root"] == "event":
                    path = ("graph." if graph else "") + row["path"]
                    made = Field(path, row["type"], row["label"] == "repeated", row["enum"] == "True")
                    fields[path] = fields.get(path, made) if graph else made
        enums = {}
        if enums_json is not None:
            told = json.loads(Path(enums_json).read_text(encoding="utf-8"))
            enums = {name: frozenset(m["name"] for m in members) for name, members in told.get("enums", {}).items()}
        return cls(fields.values(), enums)


@cache
def _builtin() -> Schema:
    fields = list(_declared(OTHERS.split()))
    for noun in NOUNS.split():
        fields += [*_declared([noun]), *_declared(NOUN.split(), noun.rstrip("*") + ".")]
    fields += [*_declared(GRAPH.split()), *_declared(NOUN.split(), "graph.entity.")]
    return Schema(fields, ENUMS)
