"""Cells of untyped tables: missing, number, date, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

# What counts as missing, and what column names tell.
MISSING = ["", "null", "none", "nan", "n/a", "na", "-"]
SENSITIVE = {"email": "email|e-mail|邮箱|邮件", "phone": "phone|mobile|tel|电话|手机", "id": "(^|[_ -])(id|身份证|证件|账号|账户|编号)($|[_ -])", "name": "name|姓名|联系人|客户名称", "address": "address|地址|住址"}
ENTITY = {"person": "name|姓名|联系人|负责人|作者|人员|员工|客户", "location": "address|地址|地点|位置|区域|城市|省|市|县|国家|地区|经纬度", "event": "event|事件|活动|事项|类型|状态|category|类别|主题"}
NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*[.]?([0-9]+(_[0-9]+)*)?|[.][0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"
DATES = ((r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"), (r"^[0-9]{4}[.][0-9]{1,2}[.][0-9]{1,2}$", "y.M.d"), (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "y-M-d H:m:s"), (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$", "y/M/d H:m:s"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def missing(c: Column) -> Column:
    """c: a trimmed string."""
    return c.isNull() | F.lower(c).isin(MISSING)


def number(c: Column) -> Column:
    """Thousands commas go; words such as nan and inf are no numbers."""
    bare = F.replace(c, F.lit(","), F.lit(""))
    return F.when(bare.rlike(NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def date(c: Column) -> Column:
    """ISO text of a date or time in one of five forms, else null."""
    first = F.substring(c, 1, 19)
    found = F.coalesce(*(F.when(first.rlike(form), F.try_to_timestamp(first, F.lit(pattern))) for form, pattern in DATES))
    return F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss")


def kind(c: Column) -> Column:
    return F.when(missing(c), "missing").when(number(c).isNotNull(), "number").when(date(c).isNotNull(), "datetime").otherwise("text")


def named_like(name: Column, patterns: dict[str, str]) -> Column:
    """Categories that a column's name tells, in order."""
    return F.filter(F.array(*(F.when(name.rlike(f"(?i){p}"), F.lit(k)) for k, p in patterns.items())), lambda x: x.isNotNull())
