"""Types with scopes, defaults by position, and enumerations of validators."""

from sparkloom.sources import types

SOURCE = '''namespace model { // namespace x {
struct conf { int a = 5; // c; d
  std::optional<int> b{3}; std::vector<std::string> v; void f() { int no = 1; }
  struct inner { bool x; };
 private:
  inner _i;
};
enum class color : uint8_t { red = 0, /* a, b */ green, blue };
using node = named_type<int32_t, struct n>;
namespace deep { using id = node; typedef id other; struct conf { std::string s = "a;b{", t; }; }
}
struct conf { double d; const char* e = "x"; };
namespace a::b { class final_one final : public conf { std::map<int, bool> m = {}; }; }
std::string_view to_string(model::color c) { switch (c) { case color::red: return "Red"; case model::color::green: return "Green"; } }
'''


def test_scopes_of_types():
    assert types.type_definitions(SOURCE) == [
        ("struct", "model::conf", 0, "a", "int", "5"), ("struct", "model::conf", 1, "b", "std::optional<int>", "3"), ("struct", "model::conf", 2, "v", "std::vector<std::string>", None), ("struct", "model::conf", 3, "_i", "inner", None),
        ("struct", "model::conf::inner", 0, "x", "bool", None), ("enum", "model::color", 0, "red", None, "Red"), ("enum", "model::color", 1, "green", None, "Green"), ("enum", "model::color", 2, "blue", None, None),
        ("alias", "model::node", 0, None, "named_type<int32_t, struct n>", None), ("alias", "model::deep::id", 0, None, "node", None), ("alias", "model::deep::other", 0, None, "id", None), ("struct", "model::deep::conf", 0, "s", "std::string", '"a;b{", t'),
        ("struct", "conf", 0, "d", "double", None), ("struct", "conf", 1, "e", "const char*", '"x"'), ("struct", "a::b::final_one", 0, "m", "std::map<int, bool>", "{}"),
    ]
    assert types.type_definitions("") == [] and types.type_definitions("struct x {") == []


def test_texts_of_enumerations():
    text = 'enum kind { a, b, c };\nstd::ostream& operator<<(std::ostream& o, kind k) { switch (k) { case kind::a: return o << "A"; case kind::b: { o << "no"; } } }\nauto x = string_switch<kind>(s).match("Bee", kind::b).match("See", kind::c);\nconst char* kind_to_string(kind k) { switch (k) { case kind::c: return "Sea"; } }'
    assert [r[3::2] for r in types.type_definitions(text)] == [("a", "A"), ("b", "Bee"), ("c", "See")]


def test_aliases_end_at_types(spark):
    found = types.definitions(spark.createDataFrame([("p", SOURCE), ("q", None)], "path string, contents string"))
    assert {x.name: x.type for x in types.alias_ends(found).collect() if x.name != "model::node"} == {"model::deep::id": "node", "model::deep::other": "node"}


def test_defaults_by_position(spark):
    fields = [("model::ep", 0, "name", "string"), ("model::ep", 1, "_addr", "addr"), ("model::ep", 2, "n", "integer"), ("net::addr", 0, "host", "string"), ("net::addr", 1, "port", "integer"), ("config::w", 0, "x", "integer"), ("config::w", 1, "port", "integer"), ("config::w", 2, "z", "integer")]
    given = [(1, "ep", "model::ep(\"a,b\", net::addr(\"h\", 9'000), -1)"), (2, "ep", "model::ep{std::nullopt}"), (3, "w", 'w(net::addr("q", 1))'), (4, "string", '"s"'), (5, "ep", "whatever"), (6, None, "a::b"), (7, "addr", '{net::addr("z", x::y)}'), (8, "ep", None), (9, "ep", "ep()"), (10, "nothing", "f(1, 2)")]
    got = types.expand_defaults(spark.createDataFrame(given, "id int, type string, text string"), spark.createDataFrame(fields, "type string, ordinal int, field string, kind string"))
    want = [
        (1, "addr/host", "h"), (1, "addr/port", "9000"), (1, "n", "-1"), (1, "name", "a,b"), (2, "addr", None), (2, "n", None), (2, "name", None), (3, "host", "q"), (3, "port", "1"), (3, "z", None), (4, "", "s"), (5, "", "whatever"), (6, "", "b"),
        (7, "host", "z"), (7, "port", "y"), (8, "", None), (9, "addr", None), (9, "n", None), (9, "name", None), (10, "", "f(1, 2)"),
    ]
    assert sorted((x.id, "/".join(x.path), x.value) for x in got.collect()) == want


def test_values_that_validators_allow(spark):
    code = """bool validate_mech(const std::vector<ss::sstring>& ms) { for (auto& m : ms) { if (!std::ranges::contains(supported_mech, m)) { return false; } } }
void check_sasl(cfg& c, std::string_view mech) { if (mech != security::scram256::name && mech != security::oidc::auth::name) { throw x; } }
void run() { check_sasl(c, config::shard().sasl_mechanism(), 3); }"""
    head = """constexpr std::string_view gssapi{"GSSAPI"};
inline constexpr auto supported_mech = std::to_array<std::string_view>({gssapi, "SCRAM", other::thing});
inline constexpr auto enterprise_mech = std::to_array<std::string_view>({gssapi});
struct scram256 { static constexpr const char* name = "SCRAM-SHA-256"; };
struct auth : base { static constexpr const char* name = "OAUTHBEARER"; };"""
    four = [("a", "string_literal")] * 4
    settings = [("mechs", "std::vector<ss::sstring>", [*four, ("&validate_mech", "identifier")]), ("none", "std::vector<ss::sstring>", [*four, ("validate_other", "identifier")]), ("sasl_mechanism", "ss::sstring", four), ("other", "ss::sstring", four), ("bare", "ss::sstring", [])]
    df = spark.createDataFrame(settings, "name string, base_type string, params array<struct<value:string,kind:string>>")
    got = types.validator_enums(df, spark.createDataFrame([("v.cc", code), ("v.h", head), ("n", None)], "path string, contents string"))
    assert sorted(map(tuple, got.collect())) == [("mechs", 0, "GSSAPI", True), ("mechs", 1, "SCRAM", False), ("mechs", 2, "other::thing", False), ("sasl_mechanism", 0, "SCRAM-SHA-256", False), ("sasl_mechanism", 1, "OAUTHBEARER", False)]


def test_validators_broadcast_nothing(spark):
    """Settings and symbols grow with the sources, so none of them passes through the driver, however small the planner takes them for."""
    files = spark.createDataFrame([("v.h", "constexpr std::string_view a{\"A\"};")], "path string, contents string")
    df = spark.createDataFrame([("m", "ss::sstring", [("x", "string_literal")])], "name string, base_type string, params array<struct<value:string,kind:string>>")
    plan = types.validator_enums(df, files)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
