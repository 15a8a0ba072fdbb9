"""Outlines: the cases of Chinese outlines, and odd texts."""

from pyspark.sql import functions as F

from lexiforge.operators import outlines as O

TEXT = """# 《书》第一章：天裂

---

## 章节信息

| 项目 | 内容 |
|------|------|
| **章节名** | 天裂 |
| **视角** | 血牙 | 多余 |
| **视角** | 铁牙 |
| 只有一格 |

## 核心逻辑

### 关键设定

| 项目 | 内容 |
|------|------|
| **年龄** | 10-13岁 |

### 其他
| 不 | 算 |

## 章节结构

| 阶段 | 内容 | 时间线 |
|------|------|--------|
| **开篇** | 荒原 | 现在 |
| **血战** | 战死 |

## 详细场景设计

前言
### 场景一：村口

说明
> 薄雾未散。
>
> 包围了部落。

> 又一段
结束
> 不算

### 场景二：山林
没有引用
"""


def test_parts():
    rows = {(r[0], r[1]): r[2:] for r in O.rows_of(TEXT, O.CHINESE)}
    assert rows["title", 0][0] == "《书》第一章：天裂"
    assert rows["info", 0][1] == {"项目": "内容", "章节名": "天裂", "视角": "铁牙"}
    assert rows["settings", 0][1] == {"项目": "内容", "年龄": "10-13岁"} and ("notes", 0) not in rows
    assert rows["stage", 0][1] == {"阶段": "开篇", "内容": "荒原", "时间线": "现在"} and rows["stage", 1][1] == {"阶段": "血战", "内容": "战死"}
    assert rows["scene", 0] == ("场景一：村口", None, "薄雾未散。\n包围了部落。\n\n又一段") and rows["scene", 1] == ("场景二：山林", None, "")
    assert rows["summary", 0][2].startswith("《书》第一章：天裂\n") and "场景一：村口: 薄雾未散。" in rows["summary", 0][2]


def test_rows_of_a_table(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "no heads\n| a | b |"), (1, "# again")], "id long, text string").selectExpr("*", "1 as part")
    got = O.outline_rows(docs, "id", F.col("text")).collect()
    assert sorted((r.id, r.part) for r in got if r.id != 1) == [] and [r.title for r in got if r.part == "title"].count("again") == 1
    assert sum(r.id == 1 for r in got) == len(list(O.rows_of(TEXT, O.CHINESE))) + 2
