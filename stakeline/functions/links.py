"""HTML columns of the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stakeline.functions.addresses import short_addr


def html_link(url: Column, text: Column) -> Column:
    """Anchor that opens in a new tab; NULL if either part is."""
    return F.concat(F.lit('<a href="'), url, F.lit('" target="_blank">'), text, F.lit("</a>"))


def explorer_url(chain: Column | str, addr: Column, explorers: dict[str, str]) -> Column:
    """Block-explorer page of an address; NULL for an unknown chain."""
    chain = F.col(chain) if isinstance(chain, str) else chain
    (first, prefix), *rest = explorers.items()
    base = reduce(
        lambda case, item: case.when(chain == item[0], F.lit(item[1])),
        rest,
        F.when(chain == first, F.lit(prefix)),
    )
    return F.concat(base, addr)


def delegate_anchor(page: str, addr: Column, name: Column, ens: Column) -> Column:
    """Link captioned with the known names and the shortened address, or the bare address."""
    known = F.concat(
        F.coalesce(F.concat(name, F.lit(" - ")), F.lit("")),
        F.coalesce(F.concat(ens, F.lit(" - ")), F.lit("")),
        short_addr(addr),
    )
    caption = F.when(F.coalesce(name, ens).isNotNull(), known).otherwise(addr)
    # Fixed value: this anchor carries a blank before the equals sign.
    return F.concat(
        F.lit(f'<a href="{page}'), addr, F.lit('" target ="_blank">'), caption, F.lit("</a>")
    )
