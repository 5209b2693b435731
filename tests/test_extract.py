"""Small sources of each kind, and what they define and use."""

import pytest

from quillon.sources.extract import extract

CASES = [
    ("Java", "package a.b;\nimport java.util.*;\nimport static x.Y.z;\npublic class Dog extends Animal implements Pet {\n  private int age = 1;\n  Dog() { super(); }\n  public native void bark_it(int n);\n  void run() { new Bone().chew(); this.age; }\n  class Inner { void noop() {} }\n}\n",
     {("a.b", "pkg", ()), ("Dog", "class", ()), ("age", "field", ("Dog",)), ("Dog", "ctor", ("Dog",)), ("bark_it", "method", ("Dog",)), ("Java_a_b_Dog_bark_1it", "jni", ("a.b", "Dog")), ("run", "method", ("Dog",)), ("Inner", "class", ("Dog",)), ("noop", "method", ("Dog", "Inner"))},
     {("java.util.*", "import"), ("x.Y.z", "import"), ("Animal", "inherit"), ("Pet", "inherit"), ("Bone", "ctor"), ("chew", "call"), ("age", "field")}),
    ("Kotlin", "package k\nclass A {\n  companion object { fun make() = 1 }\n  val x = 2\n}\nfun String.shout(): Int { return go() }\n", {("k", "pkg", ()), ("A", "class", ()), ("x", "field", ("A",)), ("shout", "method", ("String",))}, {("go", "call")}),
    ("C", "#include <stdio.h>\n#define MAX 3\nstruct point { int x; };\ntypedef int number;\nint main(void) { /* no(); */ puts(\"no()\"); return 0; }\n", {("MAX", "macro", ()), ("point", "struct", ()), ("number", "type", ()), ("main", "fn", ())}, {("stdio.h", "import"), ("puts", "call")}),
    ("Cpp", "using namespace std::x;\nnamespace android {\nclass IBinder : public RefBase { void f() { g(); } };\n}\nint Foo::bar(int a) { return 0; }\nint main() { return 0; }\n", {("android", "ns", ()), ("IBinder", "class", ("android",)), ("f", "method", ("android", "IBinder")), ("bar", "method", ("Foo",)), ("main", "fn", ())}, {("std::x", "using-ns"), ("RefBase", "inherit"), ("g", "call")}),
    ("Rust", "use a::b;\nstruct S;\nimpl T for S { fn go(&self) { println!(\"x\"); call(); } }\nmod m { const K: u8 = 1; }\n", {("S", "struct", ()), ("S", "other", ()), ("go", "fn", ("S",)), ("m", "module", ()), ("K", "const", ("m",))}, {("a::b", "import"), ("println", "call"), ("call", "call"), ("T", "inherit")}),
    ("Go", 'package p\nimport (\n "fmt"\n "os"\n)\ntype T struct {}\nfunc (t T) M() { fmt.Println(1) }\nfunc F() {}\n', {("T", "type", ()), ("M", "method", ()), ("F", "fn", ())}, {("fmt", "import"), ("os", "import"), ("Println", "call")}),
    ("Python", "import os.path\nfrom a import b\nclass É:\n    def m(self):\n        return f(1).g()\n", {("É", "class", ()), ("m", "fn", ("É",))}, {("os.path", "import"), ("a", "import"), ("f", "call"), ("g", "call")}),
    ("Bash", "#!/bin/sh\nX=1\ngo() {\n  echo hi\n}\nfunction stop {\n :\n}\n", {("X", "var", ()), ("go", "fn", ()), ("stop", "fn", ())}, set()),
    ("TypeScript", "class A extends B { m(x: T): void { new C(); this.n(); } }\ninterface I {}\nfunction f() {}\nconst v = 1;\n", {("A", "class", ()), ("m", "method", ("A",)), ("I", "iface", ()), ("f", "fn", ()), ("v", "var", ())}, {("B", "inherit"), ("C", "ctor"), ("n", "call"), ("T", "type")}),
    ("Proto", "message M { enum E { A = 0; } }\nservice S { rpc Get(M) returns (M); }\n", {("M", "proto.msg", ()), ("E", "proto.enum", ("M",)), ("S", "proto.svc", ()), ("Get", "method", ("S",))}, set()),
    ("Html", '<div id="top" class="x"></div>', {("top", "xml.id", ()), ("x", "xml.id", ())}, set()),
    ("Css", ".a .b { color: red }\n#c { }\n@keyframes spin { }\n", {("a", "class", ()), ("b", "class", ()), ("c", "xml.id", ()), ("spin", "fn", ())}, set()),
    ("Scss", "@mixin box { }\n.a {\n  &.b { }\n}\n@function f() { }\n", {("box", "fn", ()), ("a", "class", ()), ("b", "class", ()), ("f", "fn", ())}, set()),
    ("Markdown", "# One\ntext\n```\n# no\n```\nTwo\n===\n", {("One", "module", ()), ("Two", "module", ())}, set()),
    ("Toml", "[a.b]\nx = 1\n", {("a.b", "module", ()), ("x", "field", ("a.b",))}, set()),
    ("Yaml", "a:\n  b: 1\nc: 2\n", {("a", "field", ()), ("b", "field", ("a",)), ("c", "field", ())}, set()),
    ("Soong", 'flags = ["-O2"]\ncc_library {\n name: "libx",\n srcs: ["a.c"],\n cflags: ["-Wall"],\n}\ngenrule { srcs: [] }\n', {("flags", "var", ()), ("libx", "soong", ("cc_library",)), ("<anon:genrule>", "soong", ("genrule",))}, {("a.c", "import"), ("-Wall", "type")}),
    ("Aidl", "package p.q;\nimport x.Y;\ninterface IFoo {\n  void go(int a);\n}\nparcelable P;\n", {("IFoo", "aidl.iface", ("p.q",)), ("go", "aidl.method", ("p.q", "IFoo")), ("P", "aidl.parcel", ("p.q",)), ("IFoo.Stub", "aidl.shadow", ("p.q",)), ("IFoo.Stub.Proxy", "aidl.shadow", ("p.q",)), ("BpIFoo", "aidl.shadow", ("p.q",)), ("BnIFoo", "aidl.shadow", ("p.q",)), ("IFoo", "aidl.shadow", ("p.q",)), ("IFooAsyncServer", "aidl.shadow", ("p.q",))}, {("x.Y", "import")}),
    ("Hidl", "package a.b@1.0;\ninterface IBar extends IBase {\n  get() generates (int x);\n};\n", {("IBar", "iface", ("a.b@1.0",)), ("get", "method", ("a.b@1.0", "IBar")), ("BpIBar", "hidl.shadow", ("a.b@1.0",)), ("BnIBar", "hidl.shadow", ("a.b@1.0",)), ("BsIBar", "hidl.shadow", ("a.b@1.0",))}, {("IBase", "inherit")}),
    ("Owners", "# c\nset noparent\na@x.com\nper-file *.c = b@x.com, c@x.com\ninclude /OTHER\n", {("a@x.com", "owner", ()), ("b@x.com", "owner", ("per-file", "*.c")), ("c@x.com", "owner", ("per-file", "*.c"))}, {("/OTHER", "import")}),
    ("Aconfig", 'package: "p"\nflag { name: "f" }\nflag {\n  name: "g"\n}\n', {("f", "aconfig", ("p",)), ("g", "aconfig", ("p",))}, set()),
    ("InitRc", "service zygote /system/bin/app\n  class main\non boot\n  start zygote\n", {("zygote", "init.svc", ("service", "/system/bin/app"))}, {("zygote", "call")}),
    ("Sepolicy", "type a, domain;\nattribute b;\nallow a b:file read; # x\n", {("a", "sepolicy", ()), ("b", "sepolicy", ("attribute",))}, {("a", "call"), ("b", "call")}),
    ("Manifest", '<manifest package="p.q"><application android:name=".App"><activity android:name="x.Main"/></application></manifest>', {("p.q.App", "manifest", ("application",)), ("x.Main", "manifest", ("activity",))}, {("p.q.App", "inherit"), ("x.Main", "inherit")}),
    ("ApiTxt", "package a.b {\n  public class C extends a.D {\n    ctor public C();\n    method public int m(int);\n    field public static final int F = 1;\n  }\n}\n", {("C", "class", ("a.b",)), ("C", "ctor", ("a.b", "C")), ("m", "method", ("a.b", "C")), ("F", "field", ("a.b", "C"))}, {("a.D", "inherit")}),
    ("Bazel", 'load("//x:y.bzl", "z")\ncc_library(name = "lib", srcs = ["a.cc"], deps = [":b"])\n', {("lib", "soong", ("bazel:cc_library",))}, {("//x:y.bzl", "import"), ("a.cc", "import"), (":b", "import")}),
    ("CMake", "add_library(core a.c)\ntarget_link_libraries(core PUBLIC m)\nfind_package(Z)\n", {("core", "soong", ("cmake:add_library",))}, {("m", "import"), ("Z", "import")}),
    ("Gn", 'import("//b.gni")\nexecutable("app") {\n  sources = [ "m.cc" ]\n  deps = [ ":l" ]\n}\n', {("app", "soong", ("gn:executable",))}, {("//b.gni", "import"), ("m.cc", "import"), (":l", "import")}),
]


@pytest.mark.parametrize("lang,text,symbols,uses", CASES, ids=[c[0] for c in CASES])
def test_rows(lang, text, symbols, uses):
    rows = extract(lang, "x", text.encode())
    got = {(r["name"], r["kind"], tuple(r["scope_path"])) for r in rows if r["symbol"]}
    assert symbols <= got, symbols - got
    used = {(r["name"], r["kind"]) for r in rows if not r["symbol"]}
    assert uses <= used, uses - used


def test_places_are_bytes():
    row = next(r for r in extract("Python", "x", "x = 'é'; f()\n".encode()) if r["name"] == "f")
    assert (row["byte_start"], row["line"], row["col"]) == (10, 1, 11)


def test_frozen_interfaces():
    assert {r["kind"] for r in extract("Aidl", "a/aidl_api/p/1/I.aidl", b"interface I {}") if r["name"] == "I"} == {"aidl.frozen", "aidl.shadow"}


def test_kinds_without_extractor_and_empty_files():
    assert extract("Json", "x.json", b"{}") == []
    assert all(extract(lang, "x", b"") == [] for lang, *_ in CASES)


def test_comments_and_strings_define_nothing():
    assert [r for r in extract("Java", "x", b'// class A {}\n/* class B {} */ String s = "class C {}";') if r["kind"] == "class"] == []
