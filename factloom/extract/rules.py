"""Extraction rules as rows. Users add rows to the rules table to teach new conventions.

A rule reads a file of one of ``exts`` that contains ``gate``; ``pattern`` is matched over the whole text in
multi-line mode. ``name``, ``a`` and ``b`` are group numbers, 0 for none. What they mean depends on the family:

symbol: name.  import: name = module or list of modules, a = imported names.
route: name = path (none: the root), a = method (else ``kind``), b = handler.
call: name = called path.

The rules are written from small grammars: a language names its modifiers, its declaring words and the form
of a name, and ``declares`` puts them together; calls, annotations and lists have a form of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from factloom.extract.brackets import balanced
from factloom.extract.calls import CLIENTS, VERBS

RULE_SCHEMA = "family string, lang string, kind string, exts array<string>, gate string, pattern string, name int, a int, b int"

# -- pieces of grammar ------------------------------------------------------------------------
GAP = r"[ \t]+"
PAD = r"[ \t]*"
WORD = r"([A-Za-z_]\w*)"
TYPE = r"([A-Z]\w*)"
DOTTED = r"([A-Za-z_][\w.]*)"
# What stands between brackets, strings and comments included, whatever its length.
INSIDE = balanced("c", 5)
# The HTTP methods that carry a route, one list for all languages: lower case, capitalised, upper case.
METHODS = VERBS[:5]
HTTP, HTTP_TITLE, HTTP_UPPER = ("|".join(map(case, METHODS)) for case in (str, str.title, str.upper))


def quoted(marks: str = "\"'`") -> str:
    """Text between quotation marks, as a group."""
    return rf"[{marks}]([^{marks}\n]*)[{marks}]"


def words(options: Iterable[str]) -> str:
    return "(?:" + "|".join(options) + ")"


def modifiers(options: Iterable[str]) -> str:
    options = list(options)
    return f"(?:{words(options)}{GAP})*" if options else ""


RULES: list[tuple] = []


def rule(family: str, lang: str, exts: Iterable[str], pattern: str, kind: str = "", gate: str = "", name: int = 1, a: int = 0, b: int = 0) -> None:
    RULES.append((family, lang, kind or ("ANY" if family == "route" else ""), list(exts), gate, pattern, name, a, b))


def declares(lang: str, exts: Iterable[str], kinds: dict[str, tuple[str, ...]], before: Iterable[str] = (), must: str = "", name: str = WORD, indent: str = PAD, after: str = "") -> None:
    """Symbols declared as ``modifiers keyword name``; ``must`` is a modifier that has to be there."""
    for kind, keywords in kinds.items():
        start = f"^{indent}" + (f"{must}{GAP}" if must else "") + modifiers(before)
        rule("symbol", lang, exts, start + words(keywords) + GAP + name + after, kind)


def annotated(mark: str, method: str, arguments: str, declaration: str) -> str:
    """An annotation with a method and arguments, other annotations on their own lines, then what it annotates."""
    return rf"{mark}{method}{arguments}[^\n]*\n(?:{PAD}(?:@|\[|#\[)[^\n]*\n)*{PAD}{declaration}"


# -- TypeScript, JavaScript and Vue ------------------------------------------------------------
JS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
WEB = (*JS, "vue")
EXPORTED = ("export", "default", "declare", "abstract")
declares("ts", JS, {"Class": ("class",), "Interface": ("interface",)}, EXPORTED)
rule("symbol", "ts", JS, f"^{PAD}{modifiers(EXPORTED)}type{GAP}{WORD}{PAD}(?:<[^=\\n]*>{PAD})?=", "Interface")
rule("symbol", "ts", JS, f"^{modifiers((*EXPORTED, 'async'))}function{PAD}\\*?{PAD}{WORD}", "Function")
rule("symbol", "ts", JS, rf"^{modifiers(('export',))}(?:const|let){GAP}{WORD}[^=\n]*=\s*(?:async\b\s*)?(?:\({INSIDE}\)|\w+)[^=;\n]*=>", "Function", gate="=>")
rule("symbol", "ts", JS, rf"(?:\.emit|@OnEvent)\(\s*{quoted()}", "Event")
rule("import", "ts", WEB, rf"^{PAD}(?:import|export)\b[^;'\"{{}}]*(?:\{{([^}}]*)\}})?[^;'\"{{}}]*\bfrom\s*{quoted()}", gate="from", name=2, a=1)
rule("import", "ts", WEB, rf"^{PAD}import{PAD}{quoted()}", gate="import")
rule("import", "ts", JS, rf"\b(?:const|let|var){GAP}([^=;]*?)\s*=\s*require\(\s*{quoted()}", gate="require", name=2, a=1)
rule("route", "ts", JS, rf"\b(?:gql|graphql)\s*`\s*(query|mutation|subscription)\s+{WORD}", gate="`", name=2, a=1, b=2)
for _client in (r"fetch", rf"(?<![\w$]){CLIENTS}\s*\.\s*(?:{HTTP})", r"new\s+WebSocket"):
    rule("call", "ts", WEB, rf"(?<![\w$.]){_client}\s*\(\s*{quoted()}")
rule("symbol", "vue", ("vue",), f"^{PAD}{modifiers(('export', 'async'))}function{GAP}{WORD}", "Function")
rule("symbol", "vue", ("vue",), rf"^{PAD}name\s*:\s*{quoted()}", "Class")

# -- Python -------------------------------------------------------------------------------------
PY = ("py",)
declares("py", PY, {"Class": ("class",), "Function": ("def",)}, ("async",), indent="")
rule("import", "py", PY, rf"^{PAD}from{GAP}([\w.]+){GAP}import{GAP}(\([^)]*\)|[^\n#(]+)", a=2)
rule("import", "py", PY, rf"^{PAD}import{GAP}([\w.]+(?:{PAD},{PAD}[\w.]+|{GAP}as{GAP}\w+)*)")
rule("route", "py", PY, rf"\b(?:re_)?path\(\s*r?{quoted(chr(34) + chr(39))}\s*,\s*([\w.]+)", gate="path(", b=2)
rule("call", "py", PY, rf"^[^@\n]*\.\s*(?:{HTTP})\(\s*f?{quoted(chr(34) + chr(39))}")
rule("call", "py", PY, rf"\b[Ww]eb[Ss]ockets?\w*\.connect\(\s*f?{quoted(chr(34) + chr(39))}", gate="connect")

# -- Rust ---------------------------------------------------------------------------------------
RS = ("rs",)
declares("rs", RS, {"Class": ("struct", "enum"), "Interface": ("trait",), "Function": ("fn",)}, ("async", "unsafe", "const"), must="pub", indent="")
rule("import", "rs", RS, rf"^{PAD}(?:pub{GAP})?use{GAP}([\w:]*\w)(?:::(?:\{{([^;]*)\}}|\*))?(?:{GAP}as{GAP}\w+)?\s*;", gate="use", a=2)
rule("route", "rs", RS, rf"\.route\(\s*{quoted(chr(34))}\s*,\s*(?:\w+::)*({HTTP})\(\s*([\w:]+)", b=3, a=2)
rule("route", "rs", RS, annotated(r"#\[", rf"({HTTP})", rf"\(\s*{quoted(chr(34))}", rf"(?:pub{GAP})?(?:async{GAP})?fn{GAP}{WORD}"), gate="#[", name=2, a=1, b=3)
rule("call", "rs", RS, rf"\bconnect_async\s*\(\s*{quoted(chr(34))}")

# -- Go, Java, Kotlin ---------------------------------------------------------------------------
GO = ("go",)
rule("symbol", "go", GO, f"^type{GAP}{TYPE}{GAP}struct\\b", "Class")
rule("symbol", "go", GO, f"^type{GAP}{TYPE}{GAP}interface\\b", "Interface")
rule("symbol", "go", GO, rf"^func{GAP}(?:\([^()]*\){PAD})?{TYPE}{PAD}[(\[]", "Function")
rule("import", "go", GO, r"^import[ \t]*\(([^)]*)\)")
rule("import", "go", GO, rf"^import{GAP}(?:[\w.]+{GAP})?({quoted(chr(34)).replace('(', '(?:', 1)})")
JVM = ("java", "kt")
VISIBLE = ("public", "private", "protected", "internal", "abstract", "final", "static", "sealed", "open", "data")
declares("java", JVM, {"Class": ("class", "enum", "record", "object"), "Interface": ("interface",)}, VISIBLE, name=TYPE)
declares("java", ("kt",), {"Function": ("fun",)}, (*VISIBLE, "suspend", "inline"), name=rf"(?:<[^>\n]*>{PAD})?{WORD}", indent="")
rule("import", "java", JVM, rf"^import{GAP}(?:static{GAP})?([\w.]+\*?)")
_SPRING = rf"(?:\(\s*(?:(?:(?:value|path)\s*=\s*)?\{{?\s*{quoted(chr(34))})?{INSIDE}\))?"
rule("route", "java", JVM, annotated("@", rf"({HTTP_TITLE})Mapping\b", _SPRING, r"[^\n(;]*?(\w+)\s*\("), gate="Mapping", name=2, a=1, b=3)

# -- Ruby, Elixir, PHP, C# ----------------------------------------------------------------------
RUBY = ("rb", "jbuilder")
declares("rb", RUBY, {"Class": ("class", "module")}, name=r"([A-Z][\w:]*)", indent="")
declares("rb", RUBY, {"Function": ("def",)}, name=r"(?:self\.)?([a-z_]\w*[?!=]?)")
rule("import", "rb", ("rb",), rf"^{PAD}require(?:_relative)?{GAP}{quoted(chr(34) + chr(39))}")
rule("route", "rb", ("rb",), rf"^{PAD}({HTTP}){GAP}{quoted(chr(34) + chr(39))}(?:\s*,\s*to:\s*{quoted(chr(34) + chr(39))})?", name=2, a=1, b=3)
rule("route", "rb", ("rb",), rf"^{PAD}resources?{GAP}:(\w+)", "RESOURCE", b=1)
EX = ("ex", "exs")
declares("ex", EX, {"Class": ("defmodule",)}, name=r"([A-Z][\w.]*)")
declares("ex", EX, {"Function": ("def",)}, name=r"([a-z_]\w*[?!]?)")
rule("import", "ex", EX, rf"^{PAD}(?:alias|import|use){GAP}([A-Z][\w.]*)")
rule("route", "ex", EX, rf"^{PAD}({HTTP}){GAP}{quoted(chr(34))}\s*,\s*([\w.]+)", name=2, a=1, b=3)
PHP = ("php",)
declares("php", PHP, {"Class": ("class",), "Interface": ("interface",)}, ("abstract", "final", "readonly"), indent="")
declares("php", PHP, {"Function": ("function",)}, indent="", after=r"\s*\(")
rule("import", "php", PHP, rf"^use{GAP}([\w\\]+)")
CS = ("cs",)
CS_WORDS = ("abstract", "async", "override", "partial", "sealed", "static", "virtual")
declares("cs", CS, {"Class": ("class", "struct", "record", "enum"), "Interface": ("interface",)}, CS_WORDS, must="public", name=TYPE)
rule("symbol", "cs", CS, rf"^{PAD}public{GAP}{modifiers(CS_WORDS)}[\w.<>\[\],?]+{GAP}{TYPE}\s*\(", "Function")
rule("import", "cs", CS, rf"^using{GAP}(?:static{GAP})?([\w.]+)\s*;")
rule("route", "cs", CS, annotated(r"\[Http", rf"({HTTP_TITLE})", rf"(?:\(\s*{quoted(chr(34))}\s*\))?\]", rf"public{GAP}[^\n(]*?(\w+)\s*\("), gate="[Http", name=2, a=1, b=3)

# -- Swift, Objective-C, C, C++, Scala, Dart ----------------------------------------------------
SWIFT = ("swift",)
declares("swift", SWIFT, {"Class": ("class", "struct", "enum", "actor"), "Interface": ("protocol",), "Function": ("func",)}, ("public", "open", "internal", "final", "private"), indent="")
rule("import", "swift", SWIFT, rf"^import{GAP}([\w.]+)")
rule("route", "swift", SWIFT, rf"\b{words(('app', 'router', 'routes', 'server'))}\.({HTTP})\(\s*{quoted(chr(34))}(?:[^\n]*?\buse:\s*([\w.]+))?", name=2, a=1, b=3)
OC = ("m", "mm")
declares("objc", OC, {"Class": ("@interface", "@implementation"), "Interface": ("@protocol",)}, indent="")
rule("symbol", "objc", OC, rf"^[+-]\s*\([^()\n]*\)\s*{WORD}", "Function")
rule("import", "objc", OC, r"^#import[ \t]+[<\"]([^<>\"\n]+)")
C = ("c", "h", "cpp", "hpp", "cc", "cxx")
CPP = ("cpp", "hpp", "cc", "cxx")
declares("c", C, {"Class": ("struct",)}, ("typedef",), indent="")
declares("c", CPP, {"Class": ("class",)}, indent="")
# a definition: type words and a name at the line's start, parameters, then a brace before any semicolon
rule("symbol", "c", C, rf"^(?!(?:return|else|typedef)\b)(?:[A-Za-z_][\w:<>,]*[ \t*&]+)+{WORD}\s*\({INSIDE}\)[^;{{}}()]*\{{", "Function")
rule("import", "c", C, r"^#[ \t]*include[ \t]+[<\"]([^<>\"\n]+)")
SCALA = ("scala",)
declares("scala", SCALA, {"Class": ("class", "object"), "Interface": ("trait",), "Function": ("def",)}, ("sealed", "abstract", "final", "case", "implicit", "override", "private", "protected"))
rule("import", "scala", SCALA, rf"^import{GAP}([\w.]*\w)(?:\.\{{([^}}]*)\}})?", a=2)
DART = ("dart",)
declares("dart", DART, {"Class": ("class",)}, ("abstract", "base", "final", "sealed"), indent="")
rule("symbol", "dart", DART, rf"^[A-Za-z_][\w<>?,]*{GAP}{WORD}\s*\({INSIDE}\)\s*(?:async\s*)?(?:\{{|=>)", "Function")
rule("import", "dart", DART, rf"^(?:import|export){GAP}{quoted(chr(34) + chr(39))}")

# -- Haskell, Clojure, GraphQL, Protobuf, Gherkin, Godot ----------------------------------------
HS = ("hs",)
declares("hs", HS, {"Class": ("data", "newtype")}, name=r"([A-Z][\w']*)", indent="")
declares("hs", HS, {"Interface": ("class",)}, name=r"(?:[^\n]*=>[ \t]*)?([A-Z][\w']*)", indent="")
rule("symbol", "hs", HS, r"^([a-z_][\w']*)[ \t]*::", "Function")
rule("import", "hs", HS, rf"^import{GAP}(?:qualified{GAP})?([A-Z][\w.]*)")
rule("route", "hs", HS, rf"^{PAD}(/\S*){GAP}[A-Z]\w*R{GAP}({HTTP_UPPER})\b", a=2)
CLJ = ("clj", "cljs")
LISP = r"([A-Za-z][^\s()\[\]{}\"]*)"
for _kind, _forms in (("Function", ("defn", "defn-")), ("Class", ("defrecord", "deftype")), ("Interface", ("defprotocol",))):
    rule("symbol", "clj", CLJ, rf"\({words(_forms)}\s+{LISP}", _kind)
rule("route", "clj", CLJ, rf"\(({HTTP_UPPER}|ANY|HEAD|OPTIONS)\s+{quoted(chr(34))}", name=2, a=1)
GQL = ("graphql", "gql")
declares("gql", GQL, {"Class": ("type", "input", "enum", "union", "scalar"), "Interface": ("interface",)}, ("extend",), name=TYPE, indent="")
rule("route", "gql", GQL, rf"^{PAD}(query|mutation|subscription){GAP}{WORD}", name=2, a=1, b=2)
PROTO = ("proto",)
declares("proto", PROTO, {"Class": ("message", "enum"), "Interface": ("service",)})
rule("import", "proto", PROTO, rf"^import{GAP}(?:(?:public|weak){GAP})?{quoted(chr(34))}")
FEATURE = ("feature",)
rule("symbol", "gherkin", FEATURE, rf"^{PAD}Feature:{PAD}(\S[^\n]*?){PAD}$", "Class")
rule("symbol", "gherkin", FEATURE, rf"^{PAD}Scenario(?: Outline)?:{PAD}(\S[^\n]*?){PAD}$", "Function")
GD = ("gd",)
declares("gd", GD, {"Class": ("class_name",), "Function": ("func",), "Event": ("signal",)}, ("static",), indent="")
GODOT = r"\"\*?(res://[^\"\n]+)\""
rule("import", "gd", GD, rf"\b(?:pre)?load\(\s*{GODOT}", gate="res://")
rule("symbol", "tscn", ("tscn",), rf"^\[node{GAP}name={quoted(chr(34))}", "Class")
rule("import", "godot", ("godot",), rf"^\w+{PAD}={PAD}{GODOT}", gate="res://")
rule("symbol", "godot", ("godot",), rf"^(\w+){PAD}={PAD}\"\*res://", "Class", gate="res://")

# -- schemas and infrastructure -----------------------------------------------------------------
# Prisma's scalar types.
SCALARS = ("String", "Int", "BigInt", "Float", "Decimal", "Boolean", "DateTime", "Json", "Bytes")
PRISMA = ("prisma",)
declares("prisma", PRISMA, {"Class": ("model", "enum")}, after=rf"{PAD}\{{")
rule("import", "prisma", PRISMA, rf"^{GAP}\w+{GAP}(?!{words(SCALARS)}\b){TYPE}(?:\[\]|\?)?(?=\s|$)", gate="model")
SQL = ("sql",)
_NAME = r"[\"'`\[]?(?:\w+\.)?(\w+)[\"'`\]]?"
CREATES_TABLE = rf"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?{_NAME}"
rule("symbol", "sql", SQL, rf"(?i){CREATES_TABLE}\s*\(", "Class")
rule("import", "sql", SQL, rf"(?i)\breferences\s+{_NAME}")
TF = ("tf",)
# blocks are named as an expression names them: type.name, data.type.name, module.name
rule("symbol", "tf", TF, rf"^{PAD}resource{GAP}(\"[^\"\n]+\"{GAP}\"[^\"\n]+\")", "Class")
rule("symbol", "tf", TF, rf"^{PAD}(data{GAP}\"[^\"\n]+\"{GAP}\"[^\"\n]+\")", "Class")
rule("symbol", "tf", TF, rf"^{PAD}(module{GAP}\"[^\"\n]+\")", "Class")
rule("import", "tf", TF, r"\$\{([a-z]\w*(?:\.[a-z]\w*)+)\}")
YAML = ("yaml", "yml")
_REFERENCE = r"(?:configMap|secret)(?:Ref|KeyRef)?"
rule("import", "k8s", YAML, rf"\b{_REFERENCE}:{PAD}\n\s+name:{PAD}([^\s#]+)", gate="kind:")
rule("import", "k8s", YAML, rf"\b{_REFERENCE}:{PAD}\{{[^}}\n]*\bname:{PAD}([^\s,}}]+)", gate="kind:")
rule("import", "k8s", YAML, rf"\b(?:serviceAccountName|claimName):{PAD}([^\s#]+)", gate="kind:")
rule("import", "ci", YAML, rf"\buses:{PAD}([^\s#]+)", gate="uses:")
rule("import", "openapi", YAML, rf"\$ref:{PAD}[\"']#/(?:components/schemas|definitions)/(\w+)")


def rules_table(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """All rules as a DataFrame, with the caller's rows of the same schema after ours."""
    return spark.createDataFrame(RULES + list(extra or []), RULE_SCHEMA)


# -- declaration rules -----------------------------------------------------------------------------
# block: groups name, head, body (0 for none). ``scope`` says where fields and relations are read.
DECL_SCHEMA = (
    "kind string, exts array<string>, file string, gate string, block string, name int, head int, body int, "
    "accept string, reject string, fields string, relations string, scope string, table string, table_in string, default_table string"
)


def _decl(kind, exts, block, name=1, head=0, body=0, file="", gate="", accept="", reject="", fields="", relations="", scope="block", table="", table_in="body", default="none"):
    return (kind, list(exts), file, gate, block, name, head, body, accept, reject, fields, relations, scope, table, table_in, default)


# A Python class: its bases, then every line that is blank or indented.
_PY_CLASS = rf"(?m)^class{GAP}(\w+)\s*\(({INSIDE})\)\s*:[^\n]*((?:\n(?:{GAP}[^\n]*|{PAD}(?=\n)))*)"
_PY_FIELD = r"(?m)^ {4}(\w+)"
# Decorators or annotations with arguments of any length, between the one asked for and the class.
_ARGS = rf"(?:\(({INSIDE})\))?"
_MORE = rf"(?:\s*@[\w.]+(?:\({INSIDE}\))?)*"
_TS_CLASS = rf"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"
_TO = words(("ManyToMany", "ManyToOne", "OneToMany", "OneToOne"))
# in a probe: head, NUL, body, SOH, path mark
_HEAD_END = r"[^\x00]*\x00"

DECL_RULES = [
    _decl("prisma", PRISMA, rf"(?m)^{PAD}model{GAP}(\w+){PAD}\{{({balanced('prisma', 3)})\}}", body=2, fields=rf"(?m)^{PAD}([A-Za-z]\w*){GAP}[A-Za-z]",
          relations=rf"(?m)^{PAD}[A-Za-z]\w*{GAP}(?!{words(SCALARS)}\b){TYPE}", table=rf"@@map\(\s*{quoted(chr(34))}", default="name"),
    _decl("prisma-enum", PRISMA, rf"(?m)^{PAD}enum{GAP}(\w+){PAD}\{{"),
    _decl("django", PY, _PY_CLASS, head=2, body=3, file="models.py", gate="models.", accept=rf"Model\b\s*(?:,{_HEAD_END[:-4]})?\x00|\n {{4}}\w+\s*=\s*models\.|\n {{4}}class{GAP}Meta\b",
          fields=_PY_FIELD + r"\s*=\s*models\.", relations=r"\bmodels\.(?:ForeignKey|ManyToManyField|OneToOneField)\(\s*[\"']?(?!self\b)(\w+)"),
    _decl("sqlmodel", PY, _PY_CLASS, head=2, body=3, accept=rf"(?:\btable\s*=\s*True|\bSQLModel\b){_HEAD_END}", fields=_PY_FIELD + r"\s*:", default="lower_if_table"),
    _decl("pydantic", PY, _PY_CLASS, head=2, body=3, gate="BaseModel", accept=rf"\bBaseModel\b{_HEAD_END}", reject=rf"(?:\btable\s*=\s*True|\bSQLModel\b){_HEAD_END}", fields=_PY_FIELD + r"\s*:"),
    _decl("sqlalchemy", PY, _PY_CLASS, head=2, body=3, accept=rf"\b__tablename__\s*=|\bdb\.Model\b{_HEAD_END}",
          fields=_PY_FIELD + r"\s*(?::[^=\n]*)?=\s*(?:db\.)?(?:Column|mapped_column)\(", table=rf"\b__tablename__\s*=\s*{quoted(chr(34) + chr(39))}"),
    _decl("mongoose", ("js", "ts"), rf"\bmodel\(\s*{quoted(chr(34) + chr(39))}", gate="mongoose", scope="file", fields=r"(?m)^ {2}(\w+)\s*:", relations=rf"\bref\s*:\s*{quoted(chr(34) + chr(39))}"),
    _decl("mongoose", ("js", "ts"), rf"@Schema{_ARGS}{_MORE}{_TS_CLASS}", name=2, head=1, gate="@Schema", scope="file",
          fields=rf"@Prop\({INSIDE}\)\s*(?:readonly\s+)?(\w+)\s*[?!]?\s*[:;]", table=rf"\bcollection\s*:\s*{quoted(chr(34) + chr(39))}", table_in="head"),
    _decl("typeorm", ("ts",), rf"@Entity{_ARGS}{_MORE}{_TS_CLASS}", name=2, head=1, gate="@Entity", scope="file",
          fields=rf"@(?:Primary\w*)?Column\({INSIDE}\)\s*(?:readonly\s+)?(\w+)\s*[?!]?\s*[:;]", relations=rf"@{_TO}\(\s*(?:\w+|\(\s*\w*\s*\))\s*=>\s*(\w+)",
          table=rf"(?:^\s*|\bname\s*:\s*){quoted(chr(34) + chr(39))}", table_in="head"),
    _decl("sql", ("rb",), rf"\bcreate_table\s+{quoted(chr(34))}", file="schema.rb", default="name"),
    _decl("rails", ("rb",), rf"(?m)^class{GAP}(\w+)\s*<\s*(?:ApplicationRecord|ActiveRecord::Base)\b", scope="file",
          relations=rf"(?m)^{GAP}(?:belongs_to|has_(?:one|many|and_belongs_to_many)){GAP}:(\w+)"),
    _decl("drizzle", ("ts", "js"), rf"\bconst{GAP}(\w+)\s*=\s*(?:mysql|pg|sqlite)Table\(\s*({quoted(chr(34) + chr(39)).replace('(', '(?:', 1)})", head=2, gate="Table(", scope="file",
          relations=r"\breferences\(\s*\(\s*\)\s*=>\s*(\w+)", table=r"(\w+)", table_in="head"),
    _decl("eloquent", PHP, rf"(?m)^(?:(?:abstract|final){GAP})*class{GAP}(?!\w*(?:Controller|Exception|Test)\b)(\w+)\s+extends\s+([\w\\]+)", head=2, scope="file", accept=r"(?:Authenticatable|Model|Pivot)\x00|\x01Models",
          relations=r"->(?:belongsTo(?:Many)?|has(?:One|Many)|morphMany)\(\s*(\w+)::class", table=rf"\$table\s*=\s*{quoted(chr(34) + chr(39))}", table_in="file"),
    _decl("jpa", ("java",), rf"@Entity\b((?:\({INSIDE}\))?{_MORE})\s*(?:(?:public|abstract|final)\s+)*class\s+(\w+)", name=2, head=1, gate="@Entity", scope="file",
          relations=rf"@{_TO}\b(?:\({INSIDE}\))?{_MORE}\s*(?:private|protected)\s+(?:(?:Collection|List|Set)<)?(\w+)", table=rf"@Table\s*\([^)]*?\bname\s*=\s*{quoted(chr(34))}", table_in="head"),
    _decl("gorm", GO, rf"(?m)^type{GAP}(\w+){GAP}struct{PAD}\{{({balanced('go', 3)})\}}", body=2, gate="gorm", accept=r"\bgorm(?::|\.Model)", fields=rf"(?m)^{GAP}(\w+){GAP}\S"),
    _decl("ecto", EX, rf"(?s)\bdefmodule{GAP}(?:\w+\.)*(\w+){GAP}do\b(.*?\bschema{GAP}\"\w+\"{GAP}do\b)", body=2, gate="schema \"", scope="file",
          relations=rf"(?m)^{PAD}(?:belongs_to|has_many|has_one){GAP}:(\w+)", table=rf"\bschema{GAP}{quoted(chr(34))}"),
    _decl("rust", RS, rf"(?m)^pub{GAP}struct{GAP}(\w+)[^{{;\n]*\{{({balanced('rs', 3)})\}}", body=2, fields=rf"(?m)^{GAP}pub{GAP}(\w+)\s*:"),
]


def declaration_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECL_RULES, DECL_SCHEMA)
