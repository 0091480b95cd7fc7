"""Rule settings: defaults, and a TOML file over them."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

#: The lists that rules start from.
PARENTS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe", "mspub.exe", "visio.exe", "onenote.exe", "acrobat.exe", "acrord32.exe")
CHILDREN = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "certutil.exe", "bitsadmin.exe")
LOLBINS = (
    "certutil.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe", "wscript.exe", "cscript.exe", "msiexec.exe", "bitsadmin.exe", "wmic.exe", "msbuild.exe", "installutil.exe",
    "regasm.exe", "regsvcs.exe", "cmstp.exe", "esentutl.exe", "expand.exe", "extrac32.exe", "hh.exe", "ieexec.exe", "makecab.exe", "replace.exe",
)


@dataclass(frozen=True)
class Rules:
    suspicious_parents: tuple[str, ...] = PARENTS
    suspicious_children: tuple[str, ...] = CHILDREN
    lolbins: tuple[str, ...] = LOLBINS
    beaconing_threshold: int = 10
    detection: int = 40
    suspicious_parent: int = 20
    lolbin: int = 20
    unsigned_dll: int = 5
    external_ip: int = 2
    dns_query: int = 1
    threshold: int = 40
    cooldown: int = 300


def load_rules(text: str | None = None) -> Rules:
    """Rules from TOML text with tables rules.hunt, rules.score and rules.alert; names are lower-cased, missing fields default."""
    if text is None:
        return Rules()
    tables = tomllib.loads(text).get("rules", {})
    known = {f.name for f in fields(Rules)}
    found = {k: v for t in ("hunt", "score", "alert") for k, v in tables.get(t, {}).items() if k in known}
    return replace(Rules(), **{k: tuple(x.lower() for x in v) if isinstance(v, list) else v for k, v in found.items()})
