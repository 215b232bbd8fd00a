"""Technical attributes of product titles as ordered arrays, and conflicts between two sets of them."""

from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercanta.functions.text import has_term, normalized

#: Brands, product types and colours by the terms that name them.
BRANDS = {
    "amd": ["amd"], "c3plus": ["c3plus", "c3 plus", "c3tech", "c3 tech", "c3tech gaming"], "crucial": ["crucial"], "energizer": ["energizer"], "hp": ["hp", "hp gaming"], "intel": ["intel"],
    "kingston": ["kingston"], "lehmox": ["lehmox"], "logitech": ["logitech"], "megatron": ["megatron"], "philips": ["philips"], "plus_cable": ["plus cable"], "sandisk": ["sandisk", "san disk"], "seagate": ["seagate"], "western_digital": ["western digital", "wd"],
}
TYPES = {
    "adapter": ["adaptador", "adapter"], "cable": ["cabo", "cable"], "case": ["gabinete"], "charger": ["carregador"], "combo": ["combo", "kit teclado mouse"], "cooler": ["cooler"],
    "cpu": ["processador", "ryzen", "core i3", "core i5", "core i7", "core i9"], "headset": ["headset", "headphone", "fone", "fones"], "hub": ["hub"], "memory_ram": ["memoria ram", "ddr3", "ddr4", "ddr5"],
    "microphone": ["microfone"], "motherboard": ["placa mae"], "mouse": ["mouse"], "mousepad": ["mousepad", "mouse pad"], "notebook_stand": ["suporte notebook", "base notebook", "cooler notebook"],
    "power_supply": ["fonte"], "ssd": ["ssd"], "keyboard": ["teclado", "keyboard"], "webcam": ["webcam", "camera web"],
}
COLOURS = {"black": ["preto", "black"], "white": ["branco", "white"], "blue": ["azul", "blue"], "red": ["vermelho", "red"], "green": ["verde", "green"], "pink": ["rosa", "pink"], "gray": ["cinza", "grey", "gray"]}
#: Interfaces by pattern.
STORAGE = {"nvme": r"\bnvme\b", "sata": r"\bsata\b", "m2": r"\bm\s*2\b", "pcie": r"\bpci\s*e\b"}
CONNECTORS = {
    "usb_c": r"\busb\s*c\b|\btype\s*c\b|\btipo\s*c\b", "usb_3": r"\busb\s*3(?:\s*0)?\b", "usb_2": r"\busb\s*2(?:\s*0)?\b", "micro_usb": r"\bmicro\s*usb\b", "lightning": r"\blightning\b", "hdmi": r"\bhdmi\b", "vga": r"\bvga\b",
    "displayport": r"\bdisplay\s*port\b", "p2": r"\bp2\b", "p3": r"\bp3\b", "rj45": r"\brj\s*45\b", "bluetooth": r"\bbluetooth\b", "wifi": r"\bwi\s*fi\b", "wireless": r"\bwireless\b|\bsem\s*fio\b",
}
FIELDS = ["product_types", "brands", "capacities", "memory_generations", "storage_interfaces", "connector_interfaces", "voltages", "power_watts", "colors", "pack_quantities"]
#: Types that don't contradict each other, and conflicts that weigh most.
COMPATIBLE = [["headset", "microphone"], ["adapter", "hub"], ["notebook_stand", "cooler"]]
HIGH_RISK = ["product_types", "capacities", "memory_generations", "storage_interfaces", "connector_interfaces", "voltages", "power_watts"]


def _named(t: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*(F.when(has_term(t, terms), F.lit(name)) for name, terms in table.items())))


def _matching(t: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in table.items())))


def product_attributes(t: Column) -> dict[str, Column]:
    """Arrays of each attribute of normalised text ``t`` (see ``text.words``), each value once, in order."""
    types = _named(t, TYPES)
    types = F.when(F.array_contains(types, "mousepad"), F.array_remove(types, "mouse")).otherwise(types)
    capacities = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d+ ?(?:tb|gb|mb))\b"), 1), lambda x: F.replace(x, F.lit(" "))))
    volts = F.transform(F.regexp_extract_all(t, F.lit(r"\b(110|127|220) ?v\b"), 1), lambda x: F.concat(x, F.lit("v")))
    bivolt = F.when(t.rlike(r"\bbivolt\b"), F.array(F.lit("bivolt"))).otherwise(F.array().cast("array<string>"))
    packs = F.concat(F.regexp_extract_all(t, F.lit(r"\b(?:kit|pack|pacote|combo) ?(?:com|de)? ?(\d{1,3})\b"), 1), F.regexp_extract_all(t, F.lit(r"\b(\d{1,3}) ?(?:pecas|pcs|unidades|un)\b"), 1))
    codes = F.filter(F.regexp_extract_all(t, F.lit(r"\b([a-z]{1,8} ?\d{2,5}[a-z0-9]*)\b"), 1), lambda c: ~c.rlike(r"^(?:usb|ddr|hdmi|sata|nvme)?\d+$"))
    return {
        "product_types": types, "brands": _named(t, BRANDS), "capacities": capacities, "memory_generations": F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(ddr[345])\b"), 1)),
        "storage_interfaces": _matching(t, STORAGE), "connector_interfaces": _matching(t, CONNECTORS), "voltages": F.array_distinct(F.concat(bivolt, volts)),
        "power_watts": F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\b(\d{2,4}) ?w\b"), 1), lambda x: F.concat(x, F.lit("w")))), "colors": _named(t, COLOURS),
        "pack_quantities": F.array_distinct(packs), "model_codes": F.array_distinct(F.transform(codes, lambda c: F.translate(c, " ", "-"))),
    }


#: Names of payload values that describe a product, names that lead on to more, and how deep, how far into lists and how many.
DESCRIBING = ["name", "title", "product_name", "description", "modelo", "model", "brand", "line", "product_type", "reference", "codigo", "value_name", "value_id"]
LEADING_ON = ["product", "attributes", "catalog_sections"]
DEEPEST, LIST_ITEMS, MOST_VALUES = 4, 40, 80


def _describing(payload: str | None) -> list[str]:
    try:
        value = json.loads(payload) if payload else None
    except ValueError:
        return []
    said, waiting = [], deque([(value, 0)])
    while waiting and len(said) < MOST_VALUES:
        x, depth = waiting.popleft()
        more = []
        if isinstance(x, dict):
            said += [str(x[k]) for k in DESCRIBING if isinstance(x.get(k), (str, int, float)) and str(x[k]).strip()]
            more = [x[k] for k in LEADING_ON if k in x]
        elif isinstance(x, list):
            more = x[:LIST_ITEMS]
        if depth < DEEPEST:
            waiting.extendleft((y, depth + 1) for y in reversed(more))
    return said


@F.pandas_udf(T.ArrayType(T.StringType()))
def payload_values(payloads: pd.Series) -> pd.Series:
    """The describing values of payloads, in reading order; unreadable ones have none."""
    return payloads.map(_describing)


def described_by(title: Column, payload: Column) -> dict[str, Column]:
    """Attributes of a title together with what its payload says."""
    return product_attributes(normalized(F.concat_ws(" ", title, F.array_join(payload_values(payload), " "))))


def conflicts(left: Column, right: Column) -> Column:
    """Names of the attributes that both sides have and that share no value. ``left`` and ``right`` are structs of the arrays."""
    found = []
    for field in FIELDS:
        a, b = left[field], right[field]
        clash = (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
        if field == "voltages":
            clash &= ~F.array_contains(a, "bivolt") & ~F.array_contains(b, "bivolt")
        if field == "product_types":
            for group in COMPATIBLE:
                both = F.array(*(F.lit(x) for x in group))
                clash &= ~((F.size(F.array_except(a, both)) == 0) & (F.size(F.array_except(b, both)) == 0))
        found.append(F.when(clash, F.lit(f"{field}_conflict")))
    return F.array_compact(F.array(*found))


def conflict_penalty(found: Column) -> Column:
    """Factor on a similarity: 1 without conflict, 0.30 for a high-risk one, else 0.55 for the brand, else 0.70."""
    high = F.array(*(F.lit(f"{f}_conflict") for f in HIGH_RISK))
    return F.when(F.size(found) == 0, 1.0).when(F.arrays_overlap(found, high), 0.30).when(F.array_contains(found, "brands_conflict"), 0.55).otherwise(0.70)
