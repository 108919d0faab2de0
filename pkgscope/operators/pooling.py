"""Counters of files to features of packages, by a declared rule for each column.

Each of the table's columns is added up, or taken at its greatest, or asked for in any file; what a package has beside its files'
counters (kinds of danger in one file, densities, ratios, capabilities) follows from them. One grouped aggregate with partial sums makes
all columns, whatever their number; those a table does not have are left out. A null counter counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import danger_weight

# The kinds of danger and the counters that show them, the counters of a file's density, how columns are pooled,
# which are also given per thousand lines, and the columns of which any one is a capability.
FILE_KINDS = {
    "exec": ("exec_calls",), "process": ("process_calls",), "network": ("network_calls",), "deserialize": ("deserialize_calls",), "decode": ("decode_calls",),
    "dynamic_import": ("computed_import",), "hidden_name": ("char_code_build", "obfuscated_import"), "home": ("home_access",), "fs_walk": ("fs_walk",),
    "delete": ("file_delete",), "env": ("env_reads",), "chmod": ("chmod_calls",), "silent_except": ("try_except_pass",),
}
DENSITY = ("exec_calls", "process_calls", "network_calls", "deserialize_calls", "decode_calls", "computed_import", "char_code_build", "home_access")
LEAST_LOC, MANY_KINDS = 50, 3
SUMS = {
    "call_exec": "exec_calls", "call_process": "process_calls", "call_network": "network_calls", "call_deserialize": "deserialize_calls", "call_dynamic_attr": "dynamic_attr",
    "call_dunder_access": "dunder_access", "call_chmod": "chmod_calls", "call_file_write": "file_writes", "call_env_read": "env_reads", "call_suspicious_import": "suspicious_imports",
    "call_import_in_function": "imports_in_function", "call_try_except_pass": "try_except_pass", "call_lambda": "lambdas", "call_computed_import": "computed_import",
    "call_obfuscated_import": "obfuscated_import", "obf_char_code_build": "char_code_build", "decode_calls": "decode_calls", "decode_then_exec": "decode_then_exec",
    "install_toplevel_stmts": "toplevel_stmts", "install_toplevel_call": "toplevel_call", "install_exec_at_toplevel": "exec_at_toplevel",
    "install_net_at_toplevel": "net_at_toplevel", "install_proc_at_toplevel": "proc_at_toplevel", "pkg_loc": "loc", "pkg_parse_failures": "parse_failed",
}
GREATEST = {"install_has_cmdclass": "has_cmdclass", "install_hook_subclass": "hook_subclass", "autorun_categories": "autorun_categories"}
SUMS_AS_NAMED = (
    *[f"autorun_{when}_{kind}" for when in ("install", "import") for kind in ("network", "process", "exec", "decode", "write", "env", "secret")],
    "autorun_spawn", "autorun_native_load", "flow_decode_exec", "flow_net_exec", "flow_charcode_exec", "flow_tainted_process", "flow_download_execute", "flow_net_to_file",
    "flow_hidden_endpoint", "flow_secret_send", "proc_hidden", "proc_shell_downloader", "proc_python_inline", "proc_temp_exec", "bin_orphan_modules", "bin_compiled_init",
    "bin_net_indicators", "bin_url_count", "bin_exfil_refs", "bin_shell_cmd", "pth_code_lines", "script_downloader", "exfil_ssh", "exfil_cloud", "exfil_env", "exfil_browser",
    "exfil_wallet", "exfil_token", "net_suspicious_host", "net_suspicious_tld", "net_hardcoded_ip", "net_url_count", "obf_long_line_count",
)
ANY = {"install_has_setup_py": "is_setup", "pkg_has_readme": "is_readme", "pkg_has_license": "is_license", "pkg_has_tests": "says_test"}
PER_KLOC = ("call_exec", "call_process", "call_network", "call_deserialize", "decode_calls", "exfil_total")
CAPABILITY = (
    "autorun_install_network", "autorun_install_process", "autorun_install_exec", "autorun_install_decode", "autorun_install_write", "autorun_install_secret",
    "autorun_import_network", "autorun_import_process", "autorun_import_exec", "autorun_import_decode", "autorun_import_write", "autorun_import_secret",
    "autorun_spawn", "autorun_native_load", "flow_hidden_endpoint", "flow_secret_send", "flow_decode_exec", "flow_net_exec", "flow_charcode_exec", "flow_tainted_process",
    "flow_download_execute", "proc_hidden", "proc_shell_downloader", "proc_python_inline", "proc_temp_exec", "bin_compiled_init", "bin_net_indicators", "bin_shell_cmd",
    "pth_code_lines", "script_downloader", "decode_then_exec", "net_suspicious_host", "exfil_total", "install_exec_at_toplevel", "install_net_at_toplevel",
    "install_proc_at_toplevel", "call_obfuscated_import", "obf_char_code_build",
)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def file_kinds(columns: list[str]) -> Column:
    """The kinds of danger that a file's counters show."""
    def shown(fields: tuple) -> Column:
        return sum((_zero(f) for f in fields if f in columns), F.lit(0)) > 0

    return F.filter(F.array(*[F.when(shown(fields), F.lit(k)) for k, fields in FILE_KINDS.items()]), lambda k: k.isNotNull())


def suspicious_density(columns: list[str], loc: str = "loc") -> Column:
    """Suspicious calls per thousand lines of a file, which counts for fifty lines at least."""
    return sum((_zero(f) for f in DENSITY if f in columns), F.lit(0)) * 1000 / F.greatest(_zero(loc), F.lit(LEAST_LOC))


def pool(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the features of each package, from one row a file with counters (longs) and flags (booleans)."""
    have = [c for c in files.columns if c not in keys]
    kinds = files.withColumn("_kinds", file_kinds(have))
    made = {n: F.sum(_zero(c)) for n, c in SUMS.items() if c in have} | {n: F.sum(_zero(n)) for n in SUMS_AS_NAMED if n in have}
    made |= {n: F.max(_zero(c)) for n, c in GREATEST.items() if c in have}
    made |= {n: F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")) for n, c in ANY.items() if c in have}
    made |= {
        "pkg_n_files": F.count("*"), "worst_file_categories": F.max(F.size("_kinds")), "worst_file_danger": F.max(danger_weight(F.col("_kinds"))),
        "n_danger_files": F.count_if(F.size("_kinds") >= MANY_KINDS),
    }
    if "loc" in have:
        made["worst_file_suspicious_per_kloc"] = F.max(suspicious_density(have))
    out = kinds.groupBy(*keys).agg(*[c.cast("double" if "per_kloc" in n else "long").alias(n) for n, c in made.items()])
    leaks = [c for c in ("exfil_ssh", "exfil_cloud", "exfil_env", "exfil_browser", "exfil_wallet", "exfil_token") if c in out.columns]
    if leaks:
        out = out.withColumn("exfil_total", sum((F.col(c) for c in leaks), F.lit(0)))
    if "pkg_loc" in out.columns:
        out = out.withColumns({f"{c}_per_kloc": F.col(c) / (F.greatest("pkg_loc", F.lit(1)) / 1000) for c in PER_KLOC if c in out.columns})
    return out


def capabilities(packages: DataFrame) -> Column:
    """The names of a package's capabilities, of those its table can show, in the fixed order."""
    return F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in CAPABILITY if c in packages.columns]), lambda c: c.isNotNull())
