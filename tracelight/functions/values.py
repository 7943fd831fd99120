"""Values of event documents as typed columns, cast by fixed rules.

A value goes through its text: a missing one and a JSON null are NULL. Text that
is no integer is rounded where an integer is wanted (halves away from zero),
text that is no number is an error, and timestamps ignore an offset.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.errors import CompileError

INTEGER = r"^\s*[+-]?[0-9]{1,18}\s*$"


def cast_text(text: Column, kind: str) -> Column:
    if kind == "string":
        return text
    if kind == "bigint":
        return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint")).otherwise(
            F.round(text.cast("double")).cast("bigint")
        )
    return text.cast(kind)


#: Kinds that columns of a type hold as they are, and those that are widened to one.
NATIVE = {"string": "string", "boolean": "boolean", "bigint": "bigint", "double": "double", "timestamp_ntz": "timestamp_ntz"}
WIDENED = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


class Node:
    """A place in an event document: a column, and its type where it is typed; none where it is a variant.

    Steps into a variant are collected and taken at once. Steps into a struct
    are plain column access, which the optimizer prunes and pushes down to the files.
    A place may also be put together of places by name, of which none is read that isn't asked for.
    """

    def __init__(self, column: Column | None, kind: T.DataType | None = None, path: str = "$", parts: dict[str, Node] | None = None):
        self.base, self.kind, self.path, self.parts = column, kind, path, parts

    @property
    def column(self) -> Column:
        if self.parts is not None:
            return F.struct(*[n.column.alias(k) for k, n in self.parts.items()])
        return self.base if self.path == "$" else F.try_variant_get(self.base, self.path, "variant")

    def name(self, name: str) -> Node:
        if self.parts is not None:
            return self.parts.get(name) or missing()
        if isinstance(self.kind, T.StructType):
            inner = next((f for f in self.kind.fields if f.name == name), None)
            return missing() if inner is None else Node(self.base.getField(name), inner.dataType)
        if isinstance(self.kind, T.MapType):
            return Node(F.try_element_at(self.base, F.lit(name)), self.kind.valueType)
        if self.kind is not None:
            return missing()
        if any(c in name for c in "\"'\\]"):
            # no quoted form holds it
            return Node(F.try_element_at(F.try_variant_get(self.column, "$", "map<string,variant>"), F.lit(name)))
        return Node(self.base, None, f"{self.path}['{name}']")

    def index(self, i: int) -> Node:
        if self.parts is not None:
            return missing()
        if isinstance(self.kind, T.ArrayType):
            return Node(F.get(self.base, F.lit(i)), self.kind.elementType)
        return Node(self.base, None, f"{self.path}[{i}]") if self.kind is None else missing()

    def elements(self) -> tuple[Column, T.DataType | None]:
        """What a repeated field holds, as an array: a list's elements, a variant object's values, a single value alone; NULL if it is missing."""
        if isinstance(self.kind, T.ArrayType):
            return self.base, self.kind.elementType
        if self.parts is not None:
            raise CompileError("a field that is put together of columns holds one value; make it an array of structs")
        value = self.column
        alone = F.when(value.isNotNull(), F.array(value))
        if self.kind is not None:
            return alone, self.kind
        listed = F.try_variant_get(value, "$", "array<variant>")
        return F.coalesce(listed, F.map_values(F.try_variant_get(value, "$", "map<string,variant>")), alone), None

    def labelled(self, key: str) -> Node:
        """The value of the first ``{key, value}`` element with the key."""
        values, kind = self.elements()
        hit = F.get(F.filter(values, lambda x: Node(x, kind).name("key").text() == F.lit(key)), F.lit(0))
        return Node(Node(hit, kind).name("value").column, None if kind is None else Node(hit, kind).name("value").kind)

    def text(self) -> Column:
        """As text; a missing value and a JSON null are NULL."""
        if self.parts is not None:
            return F.to_json(self.column)
        if self.kind is None:
            return F.try_variant_get(self.base, self.path, "string")
        if isinstance(self.kind, T.StringType):
            return self.base
        if isinstance(self.kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(self.base)
        return self.base.cast("string")

    def cast(self, kind: str) -> Column:
        own = "" if self.kind is None else self.kind.simpleString()
        if NATIVE.get(own) == kind:
            return self.base
        if WIDENED.get(own) == kind:
            return self.base.cast(kind)
        return cast_text(self.text(), kind)


def missing() -> Node:
    return Node(F.lit(None).cast("string"), T.StringType())


def literal_text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def literal_as(value: object, kind: str) -> Column:
    """A literal cast to a field's type, once, when the query is compiled."""
    text = literal_text(value)
    try:
        if kind == "string":
            return F.lit(text)
        if kind == "bigint":
            number = Decimal(int(value)) if isinstance(value, bool) else Decimal(text.strip())
            return F.lit(int(number.quantize(Decimal(1), ROUND_HALF_UP))).cast("bigint")
        if kind == "double":
            return F.lit(float(value) if isinstance(value, bool) else float(text))
        if kind == "boolean":
            if isinstance(value, (int, float)):
                return F.lit(bool(value))
            word = text.strip().lower()
            if word not in ("true", "false", "t", "f", "1", "0", "yes", "no", "y", "n"):
                raise ValueError(text)
            return F.lit(word in ("true", "t", "1", "yes", "y"))
    except (ValueError, InvalidOperation):
        raise CompileError(f"{value!r} can't be a {kind}") from None
    return F.lit(text).cast(kind)
