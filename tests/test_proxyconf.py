"""The proxy grammar: whole, odd and refused dumps."""

from __future__ import annotations

import pytest

from tidegrid.sources import proxyconf

MAIN = r"""# configuration file /etc/px/main.conf:
user px; # a comment with { and "
http {
  upstream pool { server 10.0.0.1:81 weight=2; server unix:/run/p.sock; server app.inner; }
  include conf.d/*.conf;
  include missing.conf;
  init_by_lua_block { -- } not the end
    local s = "}" .. '{' .. [==[ } ]] ]==]
    --[[ } } ]]
    if a then b = {1, 2} end
  }
}
stream { server { listen 3306; proxy_pass [2001:db8::1]:3307; } }
# configuration file /etc/px/conf.d/a.conf:
server {
  listen 80; listen 443 ssl; server_name a.example.com "b.example.com";
  root /srv/www;
  location / { proxy_pass https://pool/x; }
  location = /one { alias /srv/one; }
  location /two { location /two/deep { include shared/pass.inc; } }
  location ~ \.php$ { fastcgi_pass $who; }
  location /closed { deny all; proxy_pass http://pool; }
  location /mixed { allow 10.0.0.0/8; deny all; proxy_pass http://pool; }
  if ($x = "a;b}") { return 403; }
  location /if { if ($y) { proxy_pass http://127.0.0.1:9; } }
  add_header X ${name}"quoted # part";
}
# configuration file /etc/px/conf.d/sub/b.conf:
server { server_name c.example.com; include ../never.conf; proxy_pass http://c.inner:8080; location /kid { } }
# configuration file /etc/px/shared/pass.inc:
grpc_pass grpcs://deep.example.com;
"""


def rows(spark, texts):
    nodes, problems = proxyconf.expanded(spark.createDataFrame(list(texts.items()), "dump string, text string").repartition(2))
    found = {}
    for r in proxyconf.routes(nodes).collect():
        found.setdefault(r.dump, []).append(r)
    return found, {(p.dump, p.file, p.severity, p.problem) for p in problems.collect()}


def test_routes_of_a_whole_dump(spark):
    found, problems = rows(spark, {"d": MAIN})
    got = {(r.server_names[0] if r.server_names else r.context, r.uri, r.directive): r for r in found["d"]}
    assert len(got) == len(found["d"])
    a = {k[1:]: (r.target, [tuple(b) for b in r.backends]) for k, r in got.items() if k[0] == "a.example.com"}
    pool = [("10.0.0.1", "81", "ip"), ("unix:/run/p.sock", None, "unix"), ("app.inner", "80", "hostname")]
    assert a == {
        ("/", "proxy_pass"): ("https://pool/x", pool), ("= /one", "static/other"): ("/srv/one", []), ("/two", "static/other"): ("/srv/www/two", []), ("/two/deep", "grpc_pass"): ("grpcs://deep.example.com", [("deep.example.com", "443", "hostname")]),
        ("~ \\.php$", "fastcgi_pass"): ("$who", [("$who", None, "dynamic")]), ("/closed", "access_control"): ("deny all", []), ("/mixed", "access_control"): ("deny all", []), ("/mixed", "proxy_pass"): ("http://pool", pool),
        ("/if", "proxy_pass"): ("http://127.0.0.1:9", [("127.0.0.1", "9", "ip")]), ("/if", "static/other"): ("/srv/www/if", []),
    }
    assert got["a.example.com", "/", "proxy_pass"].server_names == ["a.example.com", "b.example.com"] and got["a.example.com", "/", "proxy_pass"].listen == ["80", "443 ssl"]
    assert got["a.example.com", "/two/deep", "grpc_pass"].file == "/etc/px/shared/pass.inc"
    assert [tuple(b) for b in got["stream", "(TCP/UDP)", "proxy_pass"].backends] == [("2001:db8::1", "3307", "ip")]
    assert {k[1:] for k in got if k[0] == "c.example.com"} == {("/", "proxy_pass"), ("/kid", "proxy_pass")}
    assert problems == {("d", "/etc/px/main.conf", "warning", "include not expanded: missing.conf"), ("d", "/etc/px/main.conf", "warning", "Lua decides at run time"), ("d", "/etc/px/conf.d/sub/b.conf", "warning", "include not expanded: ../never.conf")}


def test_refused_dumps(spark):
    """A dump that isn't whole gives a problem and no routes, and the others theirs."""
    mark = "# configuration file /m.conf:\n"
    bad = {
        "open block": "http { server { listen 1; }", "open quote": 'http { server { server_name "x; } }', "open variable": "http { a ${x; ", "early end": "http { } }", "no semicolon": "http { listen 1 }", "empty": "http { ; }", "cut": "user x",
        "lua": "http { init_by_lua_block { a = [[ } }", "lua text": 'http { init_by_lua_block { a = "} }', "deep": "a {" * 30_000,
    }
    texts = {k: mark + v for k, v in bad.items()} | {"none": "nothing here", "null": None}
    texts["cycle"] = mark + "http { include /x.conf; }\n# configuration file /x.conf:\ninclude /y.conf;\n# configuration file /y.conf:\nserver { include /x.conf; }\n"
    texts["good"] = mark + "http { server { listen 1; } }"
    found, problems = rows(spark, texts)
    assert set(found) == {"good"} and [(r.uri, r.directive) for r in found["good"]] == [("/", "static/other")]
    errors = {p[0]: p[3] for p in problems if p[2] == "error"}
    assert set(errors) == set(texts) - {"good"} and errors["cycle"] == "include cycle: /x.conf" and errors["none"] == "no configuration files"
    assert errors["lua"] == "Lua bracket is not closed" and errors["open quote"] == "quote is not closed" and errors["open variable"] == "variable is not closed" and errors["deep"].startswith("more than")


def test_a_file_that_is_included_twice(spark):
    """Its directives belong to both blocks, each with its own surroundings."""
    text = "# configuration file /m.conf:\nhttp { server { server_name a; include /i.conf; } server { server_name b; include /i.conf; root /r; } }\n# configuration file /i.conf:\nlisten 8;\nlocation /x { }\n"
    found, _ = rows(spark, {"d": text})
    assert sorted((r.server_names[0], r.listen, r.uri, r.target) for r in found["d"]) == [("a", ["8"], "/", ""), ("a", ["8"], "/x", ""), ("b", ["8"], "/", "/r/"), ("b", ["8"], "/x", "/r/x")]


def test_grammar_takes_linear_time():
    words = list(proxyconf.words('a "b\\"c"d \'e f\' ${x y}z #c ;\nq;'))
    assert words == [("a",), ('b\\"cd',), ("e f",), ("${x y}z",), ("q",), ";"]
    assert len(proxyconf.directives("a { b 1; } " * 100_000)) == 200_000
    with pytest.raises(proxyconf.Refused):
        proxyconf.directives("x_by_lua_block {" + "[" * 50_000)


def test_blocks_beside_each_other_share_rows(spark):
    """Locations of one server are few rows, whatever is in them, and each has its own route."""
    n = 2 * proxyconf.BESIDE + 1
    inside = ["proxy_pass http://h{};", "deny all;", "alias /srv/{};"]
    text = "# configuration file /m.conf:\nhttp { server { server_name a; root /r; " + " ".join(f"location /{i} {{ {inside[i % 3].format(i)} }}" for i in range(n)) + " } }\n"
    dumps = spark.createDataFrame([("d", text)], "dump string, text string")
    nodes, problems = proxyconf.expanded(dumps)
    assert problems.count() == 0 and nodes.count() == 5  # http, server, and the locations in three
    got = {r.uri: (r.server_names, r.directive, r.target) for r in proxyconf.routes(nodes).collect()}
    want = [("proxy_pass", "http://h{}"), ("access_control", "deny all"), ("static/other", "/srv/{}")]
    assert got == {"/": (["a"], "static/other", "/r/")} | {f"/{i}": (["a"], want[i % 3][0], want[i % 3][1].format(i)) for i in range(n)}
