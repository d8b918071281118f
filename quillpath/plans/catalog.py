"""Models over tables: fields, keys and relations, from which paths imply joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

RELATIONS = frozenset({"ForeignKey", "OneToOneField", "ManyToManyField", "ParentalKey", "ParentalManyToManyField"})
MANY = frozenset({"ManyToManyField", "ParentalManyToManyField"})
ONE = frozenset({"OneToOneField"})


@dataclass(frozen=True)
class Field:
    """A field of a model. kind of a reverse relation is that of its forward one after "reverse_"."""

    name: str
    kind: str
    column: str = ""
    target: str = ""
    related_name: str = ""
    related_query_name: str = ""
    through: tuple[str, str, str] = ("", "", "")  # table, column to the owner, column to the target
    reverse_of: str = ""  # name of the forward field on target
    source: str = "declared"

    @property
    def is_relation(self) -> bool:
        return self.kind.removeprefix("reverse_") in RELATIONS

    @property
    def direction(self) -> str:
        return "reverse" if self.reverse_of else "forward" if self.is_relation else ""

    @property
    def many(self) -> bool:
        """Whether one row leads to several."""
        forward = self.kind.removeprefix("reverse_")
        return forward in MANY or (bool(self.reverse_of) and forward not in ONE)


@dataclass(frozen=True)
class Model:
    label: str
    table: str
    pk: str  # field name, or "" without a key
    fields: tuple[Field, ...]
    ordering: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.label.rpartition(".")[2]


@dataclass
class Catalog:
    """Models by label. Reverse relations, `pk`, key aliases and query-name aliases are derived."""

    models: dict[str, Model]
    members: dict[str, dict[str, Field]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.members = {label: {f.name: f for f in m.fields} for label, m in self.models.items()}
        for label, model in self.models.items():
            for f in model.fields:
                if not f.is_relation or f.target not in self.models:
                    continue
                one = f.kind in ONE
                name = f.related_name or (model.name.lower() if one else f"{model.name.lower()}_set")
                back = Field(name, f"reverse_{f.kind}", target=label, reverse_of=f.name, through=f.through, source="reverse")
                if not name.endswith("+"):
                    self.members[f.target].setdefault(name, back)
                    asked = f.related_query_name or f.related_name or model.name.lower()
                    if asked != name:
                        self.members[f.target].setdefault(asked, replace(back, name=asked, source="related_query_alias"))
                if f.kind not in MANY:
                    self.members[label].setdefault(f"{f.name}_id", Field(f"{f.name}_id", self.key_kind(f.target), f.column, source="key_alias"))
            if model.pk:
                key = self.members[label][model.pk]
                self.members[label].setdefault("pk", replace(key, name="pk", source="pk_alias"))

    def key_kind(self, label: str) -> str:
        model = self.models[label]
        return next((f.kind for f in model.fields if f.name == model.pk), "BigAutoField")

    def find(self, label: str, name: str) -> Field | None:
        found = self.members[label].get(name)
        return None if found is None or found.name.endswith("+") else found

    def model(self, name: str) -> Model:
        """By label, or by object name where it is unique."""
        if name in self.models:
            return self.models[name]
        found = [m for m in self.models.values() if m.name == name]
        if len(found) != 1:
            raise KeyError(f"{'ambiguous' if found else 'unknown'} model {name}")
        return found[0]


def _fields(*specs: str) -> tuple[Field, ...]:
    """'name:Kind:column' for plain fields and 'name:Kind:column>Target:related_name' for relations."""
    out = []
    for spec in specs:
        plain, _, relation = spec.partition(">")
        name, kind, column = plain.split(":")
        target, _, related = relation.partition(":")
        out.append(Field(name, kind, column, f"shop.{target}" if target else "", related))
    return tuple(out)


def shop() -> Catalog:
    """The catalog of the test tables."""
    part = _fields("partkey:BigAutoField:p_partkey", "name:CharField:p_name", "brand:CharField:p_brand", "type:CharField:p_type", "size:IntegerField:p_size", "retailprice:FloatField:p_retailprice")
    suppliers = Field("suppliers", "ManyToManyField", target="shop.Supplier", related_name="parts", through=("lineitem", "l_partkey", "l_suppkey"))
    made = [
        Model("shop.Region", "region", "regionkey", _fields("regionkey:AutoField:r_regionkey", "name:CharField:r_name")),
        Model("shop.Nation", "nation", "nationkey", _fields("nationkey:AutoField:n_nationkey", "name:CharField:n_name", "region:ForeignKey:n_regionkey>Region:nations")),
        Model("shop.Customer", "customer", "custkey", _fields("custkey:BigAutoField:c_custkey", "name:CharField:c_name", "nation:ForeignKey:c_nationkey>Nation:customers", "acctbal:FloatField:c_acctbal", "mktsegment:CharField:c_mktsegment")),
        Model("shop.Supplier", "supplier", "suppkey", _fields("suppkey:BigAutoField:s_suppkey", "name:CharField:s_name", "nation:ForeignKey:s_nationkey>Nation:suppliers", "acctbal:FloatField:s_acctbal")),
        Model("shop.Part", "part", "partkey", (*part, suppliers)),
        Model("shop.Order", "orders", "orderkey", _fields("orderkey:BigAutoField:o_orderkey", "customer:ForeignKey:o_custkey>Customer:orders", "status:CharField:o_orderstatus", "totalprice:FloatField:o_totalprice", "orderdate:DateTimeField:o_orderdate", "priority:CharField:o_orderpriority")),
        Model("shop.LineItem", "lineitem", "", _fields("order:ForeignKey:l_orderkey>Order:lines", "part:ForeignKey:l_partkey>Part:lines", "supplier:ForeignKey:l_suppkey>Supplier:lines", "linenumber:IntegerField:l_linenumber", "quantity:FloatField:l_quantity", "extendedprice:FloatField:l_extendedprice", "discount:FloatField:l_discount", "tax:FloatField:l_tax", "returnflag:CharField:l_returnflag", "linestatus:CharField:l_linestatus", "shipdate:DateTimeField:l_shipdate")),
        Model("shop.Event", "events", "event_id", _fields("event_id:BigAutoField:event_id", "ts:DateTimeField:ts", "user:ForeignKey:user_id>Customer:events", "event_type:CharField:event_type", "value:FloatField:value", "props:JSONField:props")),
        Model("shop.Document", "documents", "doc_id", _fields("doc_id:BigAutoField:doc_id", "text:TextField:text", "lang:CharField:lang", "source:CharField:source", "n_chars:BigIntegerField:n_chars")),
        Model("shop.Label", "labels", "document", _fields("document:OneToOneField:doc_id>Document:label", "quality:IntegerField:quality", "toxic:IntegerField:toxic")),
        Model("shop.Page", "pages", "page_id", _fields("page_id:BigAutoField:page_id", "url:URLField:url", "html:TextField:html")),
        Model("shop.Conversation", "conversations", "", _fields("conv_id:BigIntegerField:conv_id", "turn:BigIntegerField:turn", "role:CharField:role", "text:TextField:text")),
    ]
    return Catalog({m.label: m for m in made})
