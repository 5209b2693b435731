"""A small source of each kind, with all that it defines and uses. The registered queries hold the extractors against these."""

# Fixed values: (kind of file, text, definitions, uses); rows are (name, kind, scope, line).
SAMPLES = [
    (
        "Java",
        'package port.main;\n'
        'import java.util.*;\n'
        'import static x.Y.z;\n'
        'public class Ferry extends Boat implements Ship {\n'
        '  private int seats = 1;\n'
        '  Ferry() { super(); }\n'
        '  public native void load_it(int n);\n'
        '  void run() { new Ramp().lower(); this.seats; }\n'
        '  class Deck { void empty() {} }\n'
        '}\n',
        [('port.main', 'pkg', '', 1), ('Ferry', 'class', '', 4), ('seats', 'field', 'Ferry', 5), ('Ferry', 'ctor', 'Ferry', 6), ('load_it', 'method', 'Ferry', 7), ('run', 'method', 'Ferry', 8), ('Deck', 'class', 'Ferry', 9), ('empty', 'method', 'Ferry::Deck', 9), ('Java_port_main_Ferry_load_1it', 'jni', 'port.main::Ferry', 7)],
        [('java.util.*', 'import', '', 2), ('x.Y.z', 'import', '', 3), ('Boat', 'inherit', 'Ferry', 4), ('Ship', 'inherit', 'Ferry', 4), ('Ramp', 'ctor', 'Ferry::run', 8), ('lower', 'call', 'Ferry::run', 8), ('seats', 'field', 'Ferry::run', 8)],
    ),
    (
        "Kotlin",
        'package k\n'
        'class A {\n'
        '  companion object { fun make() = 1 }\n'
        '  val x = 2\n'
        '}\n'
        'fun String.shout(): Int { return go() }\n',
        [('k', 'pkg', '', 1), ('A', 'class', '', 2), ('companion', 'class', 'A', 3), ('make', 'method', 'A::companion', 3), ('x', 'field', 'A', 4), ('shout', 'method', 'String', 6)],
        [('go', 'call', 'shout', 6)],
    ),
    (
        "C",
        '#include <stdio.h>\n'
        '#define MAX 3\n'
        'struct point { int x; };\n'
        'typedef int number;\n'
        'int main(void) { /* no(); */ puts("no()"); return 0; }\n',
        [('MAX', 'macro', '', 2), ('point', 'struct', '', 3), ('number', 'type', '', 4), ('main', 'fn', '', 5)],
        [('puts', 'call', 'main', 5), ('stdio.h', 'import', '', 1)],
    ),
    (
        "Cpp",
        'using namespace std::x;\n'
        'namespace android {\n'
        'class IBinder : public RefBase { void f() { g(); } };\n'
        '}\n'
        'int Foo::bar(int a) { return 0; }\n'
        'int main() { return 0; }\n',
        [('android', 'ns', '', 2), ('IBinder', 'class', 'android', 3), ('f', 'method', 'android::IBinder', 3), ('bar', 'method', 'Foo', 5), ('main', 'fn', '', 6)],
        [('RefBase', 'inherit', 'android::IBinder', 3), ('std::x', 'using-ns', '', 1), ('g', 'call', 'android::IBinder::f', 3)],
    ),
    (
        "Rust",
        'use a::b;\n'
        'struct S;\n'
        'impl T for S { fn go(&self) { println!("x"); call(); } }\n'
        'mod m { const K: u8 = 1; }\n',
        [('S', 'struct', '', 2), ('S', 'other', '', 3), ('go', 'fn', 'S', 3), ('m', 'module', '', 4), ('K', 'const', 'm', 4)],
        [('a::b', 'import', '', 1), ('T', 'inherit', '', 3), ('println', 'call', 'S::go', 3), ('call', 'call', 'S::go', 3)],
    ),
    (
        "Go",
        'package p\n'
        'import (\n'
        ' "fmt"\n'
        ' "os"\n'
        ')\n'
        'type T struct {}\n'
        'func (t T) M() { fmt.Println(1) }\n'
        'func F() {}\n',
        [('T', 'type', '', 6), ('M', 'method', '', 7), ('F', 'fn', '', 8)],
        [('Println', 'call', '', 7), ('fmt', 'import', '', 3), ('os', 'import', '', 4)],
    ),
    (
        "Python",
        'import os.path\n'
        'from a import b\n'
        'class É:\n'
        '    def m(self):\n'
        '        return f(1).g()\n',
        [('É', 'class', '', 3), ('m', 'fn', 'É', 4)],
        [('os.path', 'import', '', 1), ('a', 'import', '', 2), ('g', 'call', 'É::m', 5), ('f', 'call', 'É::m', 5)],
    ),
    (
        "Bash",
        '#!/bin/sh\n'
        'X=1\n'
        'go() {\n'
        '  echo hi\n'
        '}\n'
        'function stop {\n'
        ' :\n'
        '}\n',
        [('go', 'fn', '', 3), ('stop', 'fn', '', 6), ('X', 'var', '', 2)],
        [],
    ),
    (
        "TypeScript",
        'class A extends B { m(x: T): void { new C(); this.n(); } }\n'
        'interface I {}\n'
        'function f() {}\n'
        'const v = 1;\n',
        [('A', 'class', '', 1), ('m', 'method', 'A', 1), ('I', 'iface', '', 2), ('f', 'fn', '', 3), ('v', 'var', '', 4)],
        [('B', 'inherit', 'A', 1), ('C', 'ctor', 'A::m', 1), ('n', 'call', 'A::m', 1), ('T', 'type', 'A', 1)],
    ),
    (
        "Proto",
        'message M { enum E { A = 0; } }\n'
        'service S { rpc Get(M) returns (M); }\n',
        [('M', 'proto.msg', '', 1), ('E', 'proto.enum', 'M', 1), ('S', 'proto.svc', '', 2), ('Get', 'method', 'S', 2)],
        [],
    ),
    (
        "Html",
        '<div id="top" class="x"></div>',
        [('top', 'xml.id', '', 1), ('x', 'xml.id', '', 1)],
        [],
    ),
    (
        "Css",
        '.a .b { color: red }\n'
        '#c { }\n'
        '@keyframes spin { }\n',
        [('a', 'class', '', 1), ('b', 'class', '', 1), ('c', 'xml.id', '', 2), ('spin', 'fn', '', 3)],
        [],
    ),
    (
        "Scss",
        '@mixin box { }\n'
        '.a {\n'
        '  &.b { }\n'
        '}\n'
        '@function f() { }\n',
        [('a', 'class', '', 2), ('b', 'class', '', 3), ('box', 'fn', '', 1), ('f', 'fn', '', 5)],
        [],
    ),
    (
        "Markdown",
        '# One\n'
        'text\n'
        '```\n'
        '# no\n'
        '```\n'
        'Two\n'
        '===\n',
        [('One', 'module', '', 1), ('Two', 'module', '', 6)],
        [],
    ),
    (
        "Toml",
        '[a.b]\n'
        'x = 1\n',
        [('a.b', 'module', '', 1), ('x', 'field', 'a.b', 2)],
        [],
    ),
    (
        "Yaml",
        'a:\n'
        '  b: 1\n'
        'c: 2\n',
        [('a', 'field', '', 1), ('b', 'field', 'a', 2), ('c', 'field', '', 3)],
        [],
    ),
    (
        "Soong",
        'flags = ["-O2"]\n'
        'cc_library {\n'
        ' name: "libx",\n'
        ' srcs: ["a.c"],\n'
        ' cflags: ["-Wall"],\n'
        '}\n'
        'genrule { srcs: [] }\n',
        [('libx', 'soong', 'cc_library', 3), ('<anon:genrule>', 'soong', 'genrule', 7), ('flags', 'var', '', 1)],
        [('a.c', 'import', 'cc_library::libx::srcs', 4), ('-Wall', 'type', 'cc_library::libx::cflags', 5)],
    ),
    (
        "Aidl",
        'package p.q;\n'
        'import x.Y;\n'
        'interface IFoo {\n'
        '  void go(int a);\n'
        '}\n'
        'parcelable P;\n',
        [('IFoo', 'aidl.iface', 'p.q', 3), ('go', 'aidl.method', 'p.q::IFoo', 4), ('IFoo.Stub', 'aidl.shadow', 'p.q', 3), ('IFoo.Stub.Proxy', 'aidl.shadow', 'p.q', 3), ('BpIFoo', 'aidl.shadow', 'p.q', 3), ('BnIFoo', 'aidl.shadow', 'p.q', 3), ('IFoo', 'aidl.shadow', 'p.q', 3), ('IFooAsyncServer', 'aidl.shadow', 'p.q', 3), ('P', 'aidl.parcel', 'p.q', 6)],
        [('x.Y', 'import', 'p.q', 2)],
    ),
    (
        "Hidl",
        'package a.b@1.0;\n'
        'interface IBar extends IBase {\n'
        '  get() generates (int x);\n'
        '};\n',
        [('IBar', 'iface', 'a.b@1.0', 2), ('get', 'method', 'a.b@1.0::IBar', 3), ('BpIBar', 'hidl.shadow', 'a.b@1.0', 2), ('BnIBar', 'hidl.shadow', 'a.b@1.0', 2), ('BsIBar', 'hidl.shadow', 'a.b@1.0', 2)],
        [('IBase', 'inherit', 'a.b@1.0::IBar', 2)],
    ),
    (
        "Owners",
        '# c\n'
        'set noparent\n'
        'a@x.com\n'
        'per-file *.c = b@x.com, c@x.com\n'
        'include /OTHER\n',
        [('a@x.com', 'owner', '', 3), ('b@x.com', 'owner', 'per-file::*.c', 4), ('c@x.com', 'owner', 'per-file::*.c', 4)],
        [('/OTHER', 'import', 'OWNERS', 5)],
    ),
    (
        "Aconfig",
        'package: "p"\n'
        'flag { name: "f" }\n'
        'flag {\n'
        '  name: "g"\n'
        '}\n',
        [('f', 'aconfig', 'p', 2), ('g', 'aconfig', 'p', 4)],
        [],
    ),
    (
        "InitRc",
        'service zygote /system/bin/app\n'
        '  class main\n'
        'on boot\n'
        '  start zygote\n',
        [('zygote', 'init.svc', 'service::/system/bin/app', 1)],
        [('zygote', 'call', 'on::boot', 4)],
    ),
    (
        "Sepolicy",
        'type a, domain;\n'
        'attribute b;\n'
        'allow a b:file read; # x\n',
        [('a', 'sepolicy', '', 1), ('b', 'sepolicy', 'attribute', 2)],
        [('a', 'call', 'allow::subject', 3), ('b', 'call', 'allow::target', 3)],
    ),
    (
        "Manifest",
        '<manifest package="p.q"><application android:name=".App"><activity android:name="x.Main"/></application></manifest>',
        [('p.q.App', 'manifest', 'application', 1), ('x.Main', 'manifest', 'activity', 1)],
        [('p.q.App', 'inherit', 'application', 1), ('x.Main', 'inherit', 'activity', 1)],
    ),
    (
        "ApiTxt",
        'package a.b {\n'
        '  public class C extends a.D {\n'
        '    ctor public C();\n'
        '    method public int m(int);\n'
        '    field public static final int F = 1;\n'
        '  }\n'
        '}\n',
        [('C', 'class', 'a.b', 2), ('C', 'ctor', 'a.b::C', 3), ('m', 'method', 'a.b::C', 4), ('F', 'field', 'a.b::C', 5)],
        [('a.D', 'inherit', 'a.b::C', 2)],
    ),
    (
        "Bazel",
        'load("//x:y.bzl", "z")\n'
        'cc_library(name = "lib", srcs = ["a.cc"], deps = [":b"])\n',
        [('lib', 'soong', 'bazel:cc_library', 2)],
        [('//x:y.bzl', 'import', 'bazel:load', 1), ('a.cc', 'import', 'bazel:cc_library::lib::srcs', 2), (':b', 'import', 'bazel:cc_library::lib::deps', 2)],
    ),
    (
        "CMake",
        'add_library(core a.c)\n'
        'target_link_libraries(core PUBLIC m)\n'
        'find_package(Z)\n',
        [('core', 'soong', 'cmake:add_library', 1)],
        [('m', 'import', 'cmake:target_link_libraries::core', 2), ('Z', 'import', 'cmake:find_package', 3)],
    ),
    (
        "Gn",
        'import("//b.gni")\n'
        'executable("app") {\n'
        '  sources = [ "m.cc" ]\n'
        '  deps = [ ":l" ]\n'
        '}\n',
        [('app', 'soong', 'gn:executable', 2)],
        [('//b.gni', 'import', 'gn:import', 1), ('m.cc', 'import', 'gn:executable::app::sources', 3), (':l', 'import', 'gn:executable::app::deps', 4)],
    ),
]
