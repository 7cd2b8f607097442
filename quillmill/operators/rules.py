"""Ordered literal find-and-replace rules, schemes of rules, and their JSON stores.

A rule sees what the rules before it have left. Consecutive one-character rules become one ``translate`` where that gives the
same text, so a scheme of 62 rules is one pass.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.sources import stores

ARROW = "  →  "


@dataclass(frozen=True)
class Rule:
    """Replace ``find`` by ``replace``. A null or empty ``find`` does nothing; a null ``replace`` deletes."""

    find: str | None = ""
    replace: str | None = ""

    def display(self) -> str:
        return f"{self.find or ''}{ARROW}{self.replace or ''}"


def live(rules: Iterable[Rule]) -> list[Rule]:
    """The rules that can change a text."""
    return [Rule(r.find, r.replace or "") for r in rules if r.find and r.find != r.replace]


def _runs(rules: list[Rule]) -> list[list[Rule]]:
    """The rules in runs: one rule, or rules that may be applied at once. In such a run every find is one character of the BMP and
    different from the others, every replacement at most one, and no replacement is found by a later rule of the run."""
    runs: list[list[Rule]] = []
    one = lambda s: len(s) == 1 and s <= "￿"
    for r in rules:
        fits = one(r.find) and (not r.replace or one(r.replace))
        held = runs[-1] if runs and fits else []
        if held and one(held[0].find) and (not held[0].replace or one(held[0].replace)) and all(h.find != r.find and h.replace != r.find for h in held):
            held.append(r)
        else:
            runs.append([r])
    return runs


def apply_rules(text: Column, rules: Iterable[Rule], fuse: bool = True) -> Column:
    """``text`` after all rules in order."""
    for run in _runs(live(rules)) if fuse else [[r] for r in live(rules)]:
        if len(run) == 1:
            text = F.replace(text, F.lit(run[0].find), F.lit(run[0].replace))
        else:
            ordered = sorted(run, key=lambda r: not r.replace)  # translate deletes what has no partner, so deletions come last
            text = F.translate(text, "".join(r.find for r in ordered), "".join(r.replace for r in ordered))
    return text


def apply_rules_to_lines(lines: Column, rules: Iterable[Rule], fuse: bool = True) -> Column:
    """The rules on every line; none matches across lines."""
    rules = list(rules)
    return F.transform(lines, lambda x: apply_rules(x, rules, fuse))


def apply_rule_table(text: Column, rules: Column) -> Column:
    """The rules of an ``array<struct<find, replace>>`` column in order."""
    return F.aggregate(rules, text, lambda t, r: F.when(r["find"].isNull() | (r["find"] == ""), t).otherwise(F.replace(t, r["find"], F.coalesce(r["replace"], F.lit("")))))


@dataclass(frozen=True)
class RuleSet:
    """An ordered list of rules; changes give a new one."""

    rules: tuple[Rule, ...] = ()

    def put(self, rule: Rule, index: int | None = None) -> RuleSet:
        """Replace the rule at ``index``, or append without one."""
        if not rule.find:
            raise ValueError("find must not be empty")
        if index is None:
            return RuleSet((*self.rules, rule))
        return RuleSet((*self.rules[:index], rule, *self.rules[index + 1 :]))

    def delete(self, index: int) -> RuleSet:
        return RuleSet((*self.rules[:index], *self.rules[index + 1 :]))

    def move(self, index: int, by: int) -> RuleSet:
        """Swap with the neighbour above (-1) or below (1); nothing at the edges."""
        to = index + by
        if not 0 <= index < len(self.rules) or not 0 <= to < len(self.rules):
            return self
        out = list(self.rules)
        out[index], out[to] = out[to], out[index]
        return RuleSet(tuple(out))

    def extend(self, rules: Iterable[Rule]) -> RuleSet:
        return RuleSet((*self.rules, *rules))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """ord, find, replace."""
        return spark.createDataFrame([(k, r.find, r.replace) for k, r in enumerate(self.rules)], "ord int, find string, replace string")

    @classmethod
    def from_df(cls, table: DataFrame) -> RuleSet:
        """The rules of a table (ord, find, replace). They are a parameter of plans, so they must fit the driver."""
        return cls(tuple(Rule(r["find"], r["replace"]) for r in table.select("ord", "find", "replace").orderBy("ord").collect()))

    def save(self, path: str) -> None:
        _write(path, [{"Find": r.find, "Replace": r.replace} for r in self.rules])

    @classmethod
    def load(cls, path: str) -> RuleSet:
        """The rules in a file; none where it is missing or damaged."""
        try:
            return cls(tuple(Rule(r.get("Find", ""), r.get("Replace", "")) for r in _read(path)))
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()


@dataclass(frozen=True)
class Scheme:
    """A named list of rules."""

    name: str
    description: str = ""
    is_builtin: bool = False
    rules: tuple[Rule, ...] = field(default_factory=tuple)

    def display(self) -> str:
        return f"{'' if self.is_builtin else '* '}{self.name}  —  {self.description}"


@dataclass(frozen=True)
class SchemeCatalog:
    """Schemes in order."""

    schemes: tuple[Scheme, ...]

    @classmethod
    def default(cls) -> SchemeCatalog:
        return cls(tuple(builtin_schemes()))

    def create(self, name: str, description: str = "", rules: Iterable[Rule] = ()) -> SchemeCatalog:
        if not name.strip():
            raise ValueError("a scheme needs a name")
        return SchemeCatalog((*self.schemes, Scheme(name.strip(), description.strip(), False, tuple(rules))))

    def edit(self, index: int, **changes) -> SchemeCatalog:
        changed = replace(self.schemes[index], **{k: v.strip() if isinstance(v, str) else v for k, v in changes.items()})
        if not changed.name:
            raise ValueError("a scheme needs a name")
        return SchemeCatalog((*self.schemes[:index], changed, *self.schemes[index + 1 :]))

    def delete(self, index: int) -> SchemeCatalog:
        return SchemeCatalog((*self.schemes[:index], *self.schemes[index + 1 :]))

    def selected(self, names: Iterable[str]) -> list[Rule]:
        """The rules of the named schemes, in the order of the schemes and of their rules; repeats stay."""
        wanted = set(names)
        return [r for s in self.schemes if s.name in wanted for r in s.rules]

    def summary(self, names: Iterable[str]) -> tuple[int, int]:
        """How many schemes are named, and their rules."""
        chosen = [s for s in self.schemes if s.name in set(names)]
        return len(chosen), sum(len(s.rules) for s in chosen)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """scheme_ord, name, description, is_builtin, rules."""
        rows = [(k, s.name, s.description, s.is_builtin, [asdict(r) for r in s.rules]) for k, s in enumerate(self.schemes)]
        return spark.createDataFrame(rows, "scheme_ord int, name string, description string, is_builtin boolean, rules array<struct<find:string,replace:string>>")

    def save(self, path: str) -> None:
        _write(path, [{"Name": s.name, "Description": s.description, "IsBuiltIn": s.is_builtin, "Rules": [{"Find": r.find, "Replace": r.replace} for r in s.rules]} for s in self.schemes])

    @classmethod
    def load(cls, path: str) -> SchemeCatalog:
        """The schemes in a file; the built-in ones where it is missing, damaged or empty."""
        try:
            found = tuple(Scheme(s.get("Name", ""), s.get("Description", ""), bool(s.get("IsBuiltIn", False)), tuple(Rule(r.get("Find", ""), r.get("Replace", "")) for r in s.get("Rules") or [])) for s in _read(path))
        except (OSError, ValueError, AttributeError, TypeError):
            found = ()
        return cls(found) if found else cls.default()


def selected_rules(schemes: DataFrame, names: Iterable[str]) -> DataFrame:
    """scheme_ord, pos, find, replace of the rules of the named schemes, from the table of a catalog."""
    chosen = schemes.where(F.col("name").isin(*names)).select("scheme_ord", F.posexplode("rules").alias("pos", "r"))
    return chosen.select("scheme_ord", "pos", "r.find", "r.replace")


def scheme_summary(schemes: DataFrame, names: Iterable[str]) -> DataFrame:
    """n_schemes and n_rules of the named schemes."""
    return schemes.where(F.col("name").isin(*names)).agg(F.count(F.lit(1)).alias("n_schemes"), F.coalesce(F.sum(F.size("rules")), F.lit(0)).cast("long").alias("n_rules"))


def _copy(source: str, target: str) -> bool:
    """Copy a small file between stores; whether there was one."""
    try:
        with stores.open_read(source) as f:
            data = f.read()
    except FileNotFoundError:
        return False
    stores.replace_file(target, data, uuid.uuid4().hex[:8])
    return True


def export_config(folder: str, files: dict[str, str]) -> list[str]:
    """Copy configuration files (name -> URI) that exist into a folder of any store; the names copied."""
    stores.make_folder(folder)
    return [name for name, path in files.items() if _copy(path, f"{folder.rstrip('/')}/{name}")]


def import_config(paths: Iterable[str], files: dict[str, str]) -> list[str]:
    """Copy those of ``paths`` that have the exact name of a configuration file to its place; the names copied."""
    named = ((p.replace("\\", "/").rsplit("/", 1)[-1], p) for p in paths)
    return [name for name, path in named if name in files and _copy(path, files[name])]


def _write(path: str, data: list) -> None:
    stores.replace_file(path, json.dumps(data, ensure_ascii=False, indent=2).encode("utf-8", "surrogatepass"), uuid.uuid4().hex[:8])


def _read(path: str) -> list:
    with stores.open_read(path) as f:
        data = json.loads(f.read().decode("utf-8-sig"))
    if not isinstance(data, list):
        raise ValueError("not a list")
    return data


# Name, description and (find, replace) pairs of the built-in schemes, in their order. The pairs of the sixth follow from a rule.
_BUILTIN = [
    ("标点符号转换", "英文标点符号转中文标点（. → 。  , → ，  ! → ！  ? → ？  ; → ；  : → ：）", [
        (".", "。"), (",", "，"), ("!", "！"), ("?", "？"), (";", "；"), (":", "："),
    ]),
    ("引号括号统一", "各种引号/方括号/花括号统一为「」，中文括号（）转半角", [
        ("“", "「"), ("”", "」"), ("‘", "「"), ("’", "」"), ("『", "「"), ("』", "」"), ("〖", "「"), ("〗", "」"), ("【", "「"), ("】", "」"), ("〔", "「"),
        ("〕", "」"), ("[", "「"), ("]", "」"), ("{", "「"), ("}", "」"), ("（", "("), ("）", ")"),
    ]),
    ("特殊符号清除", "删除各类装饰符号、图形符号、音乐符号等特殊字符", [
        ("■", ""), ("□", ""), ("○", ""), ("●", ""), ("◎", ""), ("◯", ""), ("△", ""), ("▲", ""), ("▽", ""), ("▼", ""), ("◇", ""), ("◆", ""),
        ("★", ""), ("☆", ""), ("·", ""), ("*", ""), ("《", ""), ("》", ""), ("<", ""), (">", ""), ("♪", "。"), ("♭", "。"), ("♯", "。"),
    ]),
    ("横线省略号→逗号", "各种破折号、连接线、省略号等统一转为中文逗号", [
        ("--", "，"), ("……", "，"), ("…", "，"), ("...", "，"), ("⋮", "，"), ("⋯", "，"), ("⋰", "，"), ("⋱", "，"), ("——", "，"), ("—", "，"), ("–", "，"),
        ("-", "，"), ("―", "，"),
    ]),
    ("重复矛盾标点整理", "合并重复标点（、、→、  ，，→，  。。→。  ？？→？），整理逗号句号混乱等", [
        ("、、", "、"), ("、", "，"), ("，，", "，"), ("。。", "。"), ("？？", "？"), ("。，", "。"), ("，。", "。"), ("？，", "？"), ("，？", "？"), ("。？", "？"), ("？。", "？"),
        ("「，", "「"), ("「。", "「"), ("，」", "。」"), ("  ", " "),
    ]),
    ("全角字母数字→半角", "将全角英文字母和数字转为半角（Ａ→A  ａ→a  ０→0）", None),
    ("阿拉伯数字→中文", "将阿拉伯数字转为中文数字（0→零  1→一  ...  9→九）", [
        ("0", "零"), ("1", "一"), ("2", "二"), ("3", "三"), ("4", "四"), ("5", "五"), ("6", "六"), ("7", "七"), ("8", "八"), ("9", "九"),
    ]),
    ("语气词清理", "清理口语中的语气词及常见无意义填充词", [
        ("哈哈", ""), ("嗯，", "，"), ("喔。", "。"), ("咦，", "，"), ("啊，", "，"), ("吧。", "。"), ("呀，", "，"), ("唉，", "，"), ("啦，", "，"), ("喂，", "，"), ("啊。", "。"),
        ("哪，", "，"), ("啦。", "。"), ("呀。", "。"), ("啊啊", "啊"), ("唉。", ""), ("嗳，", ""), ("哎唷", ""), ("唷", ""), ("我的天。", ""), ("不，不。", "不，"),
        ("不，不，", "不，"), ("哩。", "。"), ("噢，", "，"),
    ]),
    ("词语替换", "常见中英文词语替换（chapter→章节  ※→注）", [
        ("chapter", "章节"), ("Chapter", "章节"), ("这一点", "这点"), ("一个接一个", "挨个"), ("※", "注"),
    ]),
]


def builtin_schemes() -> list[Scheme]:
    """The nine built-in schemes, 176 rules."""
    # full-width forms lie at a fixed distance from ASCII
    narrow = [(chr(ord(c) + 0xFEE0), c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    return [Scheme(name, text, True, tuple(Rule(f, r) for f, r in pairs or narrow)) for name, text, pairs in _BUILTIN]
