"""The queries of this subpackage, and their equivalents in DuckDB's SQL where it can express them."""

from __future__ import annotations

from . import chat, codes, divergence, hosts, licences, lines
from .decontaminate import op2_decontaminate
from .minhash import op1_minhash
from .packing import op5_packing
from .quality import op3_quality
from .repeats import op13_repeats
from .sharding import op7_sharding
from .toxicity import op8_toxicity

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_lines": lines.op4_lines,
    "op5_packing": op5_packing,
    "op6_host_rules": hosts.op6_host_rules,
    "op7_sharding": op7_sharding,
    "op8_toxicity": op8_toxicity,
    "op9_licences": licences.op9_licences,
    "op10_chat": chat.op10_chat,
    "op11_codes": codes.op11_codes,
    "op12_divergence": divergence.op12_divergence,
    "op13_repeats": op13_repeats,
}

ORACLES: dict[str, str] = {"op4_lines": lines.SQL, "op6_host_rules": hosts.SQL, "op10_chat": chat.SQL, "op11_codes": codes.SQL, "op12_divergence": divergence.SQL}
