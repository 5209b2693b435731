"""Tables of a code index, and the fixed names that they use."""

from __future__ import annotations

FILES = "file_id long, root_id int, relpath string, path string, lang string, size long, digest string"
CONTENTS = "file_id long, path string, lang string, content binary"
SYMBOLS = (
    "id string, name string, fqn_index string, fqn_live string, kind string, file_id long, byte_start int, byte_end int, "
    "span_start int, span_end int, line int, col int, scope_path array<string>, lang string"
)
REFS = "name string, kind string, file_id long, byte_start int, byte_end int, line int, col int, scope_path array<string>, lang string, resolved_to string"
ERRORS = "file_id long, reason string"
QUERY_LOG = (
    "ts long, cmd string, query string, hits long, shown long, files_total long, candidate_files long, elapsed_ms long, index string, version string, pid long"
)

# Ranking tier of each symbol kind by its short name; kinds that are not listed rank 10.
TIERS = {
    100: "class iface trait struct enum union",
    90: "method fn ctor",
    85: "aidl.iface aidl.method aidl.parcel aidl.frozen proto.msg proto.svc proto.enum",
    80: "soong",
    78: "aidl.shadow hidl.shadow jni",
    75: "init.svc sepolicy",
    70: "module ns pkg",
    65: "aconfig manifest",
    50: "field var const variant type",
    40: "macro annot deco",
    20: "param",
}
FUNCTION_KINDS = ("fn", "method", "ctor")

# File kinds by exact name, and by lower-case extension.
BY_NAME = {
    "Soong": "Android.bp",
    "AndroidMk": "Android.mk",
    "Bazel": "BUILD BUILD.bazel",
    "Makefile": "Makefile Kbuild GNUmakefile",
    "Owners": "OWNERS",
    "Manifest": "AndroidManifest.xml",
    "CMake": "CMakeLists.txt",
    "License": "LICENSE NOTICE METADATA MODULE_LICENSE_APACHE2 MODULE_LICENSE_BSD MODULE_LICENSE_MIT",
}
BY_EXTENSION = {
    "C": "c", "Cpp": "cc cpp cxx c++", "Header": "h", "HeaderCpp": "hpp hh hxx", "Java": "java", "Kotlin": "kt kts", "Rust": "rs", "Go": "go", "Python": "py",
    "Bash": "sh bash", "TypeScript": "ts tsx", "Html": "html htm", "Css": "css", "Scss": "scss", "Proto": "proto", "Aidl": "aidl", "Hidl": "hal", "Assembly": "s",
    "Bzl": "bzl star", "CMake": "cmake", "Gn": "gn gni", "Gradle": "gradle", "Yaml": "yaml yml", "Soong": "bp", "AndroidMk": "mk", "FlagsFile": "flags",
    "Jarjar": "jarjar", "Toml": "toml", "Aconfig": "aconfig", "InitRc": "rc", "Sepolicy": "te", "SepolicyOther": "policy", "XmlOther": "xml", "Json": "json",
    "Properties": "properties", "Cfg": "cfg", "Markdown": "md markdown",
}
# Directories that a walk does not enter, for each profile.
SKIPPED = {
    "aosp": ("out", "prebuilts", ".repo", ".git", "node_modules", ".gradle", ".idea"),
    "linux": (".git", "Documentation/output", "tools/testing/selftests/bpf/tools"),
    "generic": (".git", "node_modules", "target", "build", "dist", ".venv", "__pycache__", ".idea", ".gradle"),
}
