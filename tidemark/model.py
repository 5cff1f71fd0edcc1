"""Query specs, table schemas and vocabulary terms."""

from __future__ import annotations

from dataclasses import dataclass, field

# Vocabulary terms and constants that results must carry as they are.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_DATETIME = "http://www.w3.org/2001/XMLSchema#dateTime"
XSD_FLOAT = "http://www.w3.org/2001/XMLSchema#float"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
SAREF = "https://saref.etsi.org/core/"
MEASUREMENT = "https://saref.etsi.org/core/Measurement"
HAS_TIMESTAMP = "https://saref.etsi.org/core/hasTimestamp"
HAS_VALUE = "https://saref.etsi.org/core/hasValue"
RELATES_TO_PROPERTY = "https://saref.etsi.org/core/relatesToProperty"
RDFS_RANGE = "https://www.w3.org/2000/01/rdf-schema#range"
DCT_CREATED = "http://purl.org/dc/terms/created"
DCT_SOURCE = "http://purl.org/dc/terms/source"
DCT_DESCRIPTION = "http://purl.org/dc/terms/description"
PROV_DERIVED_FROM = "http://www.w3.org/ns/prov#wasDerivedFrom"
PROV_GENERATED_BY = "http://www.w3.org/ns/prov#generatedBy"
VOCALS_STARTED_AT = "http://w3id.org/rsp/vocals-sd#startedAt"
VOCALS_ENDED_AT = "http://w3id.org/rsp/vocals-sd#endedAt"
VOCALS_REGISTERED = "http://w3id.org/rsp/vocals-sd#registeredStreams"
LDP_CONTAINS = "http://www.w3.org/ns/ldp#contains"
LDP_INBOX = "http://www.w3.org/ns/ldp#inbox"
TREE_MEMBER = "https://w3id.org/tree#member"
TREE_VIEW = "https://w3id.org/tree#view"
TREE_NODE_CLASS = "https://w3id.org/tree#Node"
TREE_RELATION = "https://w3id.org/tree#relation"
TREE_NODE = "https://w3id.org/tree#node"
TREE_PATH = "https://w3id.org/tree#path"
TREE_VALUE = "https://w3id.org/tree#value"
TREE_GREATER_OR_EQUAL = "https://w3id.org/tree#GreaterThanOrEqualToRelation"
LDES_EVENT_STREAM = "https://w3id.org/ldes#EventStream"
LDES_TIMESTAMP_PATH = "https://w3id.org/ldes#timestampPath"
LDES_VERSION_OF_PATH = "https://w3id.org/ldes#versionOfPath"
VANN_PREFIX = "http://purl.org/vocab/vann/preferredNamespacePrefix"
PUBLIC_TYPE_INDEX = "http://www.w3.org/ns/solid/terms#publicTypeIndex"
FOCUS_PREDICATES = (RELATES_TO_PROPERTY, RDFS_RANGE)
PUBLISH_BATCH = 20
IDLE_GAP = "5 seconds"
QUERY_MODES = ("historical+live", "live")

# Identities of one deployment, not of the computation: callers may pass their own.
EVENT_BASE = "http://example.org/aggregation_event/"
DERIVED_FROM = "http://example.org/aggregator/service"
PARAMETER_BASE = "http://example.org/aggregator/parameters/"

TRIPLES_SCHEMA = (
    "stream string, member_id string, ts timestamp_ntz, s string, p string, o string, "
    "o_type string, o_datatype string, o_lang string"
)
TRIPLE = ["s", "p", "o", "o_type", "o_datatype", "o_lang"]
NOTIFICATION_SCHEMA = "type string, target string, object string"


@dataclass(frozen=True)
class WindowSpec:
    """`FROM NAMED WINDOW name ON STREAM stream [RANGE width STEP slide]`, in milliseconds."""

    width: int
    slide: int
    name: str = "w1"
    stream: str | None = None

    def __post_init__(self):
        if self.width <= 0 or self.slide <= 0:
            raise ValueError("window width and slide must be positive milliseconds")

    @property
    def overlap(self) -> int:
        """Largest number of windows one instant can fall in."""
        return -(-self.width // self.slide)


AGGREGATES = ("max", "min", "avg", "sum", "count", "sample", "group_concat")


@dataclass(frozen=True)
class Agg:
    """`(FUNC([DISTINCT] ?var) AS ?alias)`.

    `exact=n` says that the values carry at most n decimals. Sums and averages then run
    on scaled integers, so that they do not depend on the order in which rows meet.
    """

    func: str
    var: str = "value"
    name: str | None = None
    distinct: bool = False
    exact: int | None = None
    separator: str = " "

    def __post_init__(self):
        if self.func not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.func!r}")
        if self.var == "*" and (self.func != "count" or self.distinct):
            raise ValueError("only COUNT(*) takes all rows")

    def alias(self, name: str) -> "Agg":
        return Agg(self.func, self.var, name, self.distinct, self.exact, self.separator)

    @property
    def out(self) -> str:
        return self.name or f"{self.func}_{'all' if self.var == '*' else self.var}"


@dataclass(frozen=True)
class Pattern:
    """Triple pattern; a slot that starts with `?` is a variable. `window` names the window whose
    graph it is matched in, by default the query's first."""

    s: str
    p: str
    o: str
    window: str | None = None

    def slots(self):
        return (("s", self.s), ("p", self.p), ("o", self.o))

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v[1:] for _, v in self.slots() if v.startswith("?")))


@dataclass(frozen=True)
class ContinuousQuery:
    """A registered query: windows over streams, a pattern per window, aggregates, R2S."""

    aggregates: tuple[Agg, ...]
    windows: tuple[WindowSpec, ...]
    patterns: tuple[Pattern, ...] = ()
    r2s: str = "RStream"
    r2s_name: str = "output"
    group_by: tuple[str, ...] = ()
    having: str | None = None
    prefixes: dict = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.r2s not in ("RStream", "IStream", "DStream"):
            raise ValueError(f"unknown relation-to-stream operator {self.r2s!r}")
        if not self.windows:
            raise ValueError("a continuous query needs at least one window")
        if not self.aggregates:
            raise ValueError("every projected item must be an aliased aggregate")
