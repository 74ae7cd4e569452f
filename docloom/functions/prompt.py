"""Prompts from conversations: a style is a table of text forms, rendered as one expression over an array of messages.

``messages`` is an array of struct(role, text) in turn order. A message without text takes the open form. Forms hold
{system}, {role}, {msg}, {sep}, {alt} (sep on even turns, sep2 on odd ones), {round} and {tag} (the role by turn).
"""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import codec


@dataclasses.dataclass(frozen=True)
class Style:
    """head: what stands before the turns if the system text is there; bare: if it is not (None: head as well)."""

    head: str
    said: str
    open: str
    bare: str | None = None
    odd: str = ""
    first: str | None = None


#: The forms of the separator styles.
STYLES: dict[str, Style] = {
    "add_colon_single": Style("{system}{sep}", "{role}: {msg}{sep}", "{role}:"),
    "add_colon_two": Style("{system}{sep}", "{role}: {msg}{alt}", "{role}:"),
    "add_colon_space_single": Style("{system}{sep}", "{role}: {msg}{sep}", "{role}: "),
    "no_colon_single": Style("{system}", "{role}{msg}{sep}", "{role}"),
    "no_colon_two": Style("{system}", "{role}{msg}{alt}", "{role}"),
    "add_new_line_single": Style("{system}{sep}", "{role}\n{msg}{sep}", "{role}\n", bare=""),
    "llama2": Style("{system}", "{tag} {msg}{alt}", "{tag}", bare="[INST] ", first="{msg} "),
    "chatglm": Style("{system}{sep}", "{round}{role}：{msg}{sep}", "{round}{role}：", bare=""),
    "chatml": Style("{system}{sep}\n", "{role}\n{msg}{sep}\n", "{role}\n", bare=""),
    "chatintern": Style("{system}", "{role}:{msg}{alt}\n", "{role}:"),
    "dolly": Style("{system}", "{role}:\n{msg}{alt}", "{role}:\n", odd="\n\n"),
    "rwkv": Style("{system}", "{role}: {lean}\n\n", "{role}:"),
    "phoenix": Style("{system}", "{role}: <s>{msg}</s>", "{role}: <s>"),
    "robin": Style("{system}{sep}", "{role}:\n{msg}{sep}", "{role}:\n"),
    "falcon_chat": Style("{system}{sep}", "{role}: {msg}{sep}", "{role}:", bare=""),
    "chatglm3": Style("{system}", "{role}\n {msg}", "{role}", bare=""),
    "internvl_zh": Style("{message}{sep}", "{role}: {msg}{alt}", "{role}:"),
    "mpt": Style("{system}{sep}", "{role}{msg}{sep}", "{role}"),
}


@dataclasses.dataclass(frozen=True)
class Template:
    """A named prompt template."""

    name: str
    style: str
    sep: str = "\n"
    sep2: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    system_template: str = "{system_message}"
    system_message: str = ""
    stop_str: str | None = None
    stop_token_ids: tuple[int, ...] = ()
    offset: int = 0


_ASSISTANT = "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。"
_registry: dict[str, Template] = {}


def register(template: Template, override: bool = False) -> None:
    if template.name in _registry and not override:
        raise ValueError(f"{template.name} is registered already")
    _registry[template.name] = template


def template(name: str, **changes: object) -> Template:
    """A registered template, with changes; templates are values, so the registered one stays as it is."""
    return dataclasses.replace(_registry[name], **changes)


#: The built-in templates.
register(Template("Hermes-2", "mpt", "<|im_end|>", roles=("<|im_start|>user\n", "<|im_start|>assistant\n"), system_template="<|im_start|>system\n{system_message}", system_message=_ASSISTANT, stop_str="<|endoftext|>", stop_token_ids=(2, 6, 7, 8)))
register(Template("internlm2-chat", "mpt", "<|im_end|>", roles=("<|im_start|>user\n", "<|im_start|>assistant\n"), system_template="<|im_start|>system\n{system_message}", system_message=_ASSISTANT, stop_token_ids=(2, 92543, 92542)))
register(Template("phi3-chat", "mpt", "<|end|>", roles=("<|user|>\n", "<|assistant|>\n"), system_template="<|system|>\n{system_message}", system_message=_ASSISTANT, stop_token_ids=(2, 32000, 32007)))


def _form(form: str, values: dict[str, Column]) -> Column:
    parts = [F.lit(p) if k % 2 == 0 else values[p] for k, p in enumerate(re.split(r"\{(\w+)\}", form)) if p or k % 2]
    return F.concat(*parts) if parts else F.lit("")


def render(messages: Column, t: Template, system_message: Column | None = None) -> Column:
    """The prompt of messages in the template's style; system_message overrides the template's (null: the template's)."""
    style = STYLES[t.style]
    message = F.lit(t.system_message) if system_message is None else F.coalesce(system_message, F.lit(t.system_message))
    before, _, after = t.system_template.partition("{system_message}")
    fixed = {"sep": F.lit(t.sep), "message": message, "system": F.concat(F.lit(before), message, F.lit(after))}
    head = _form(style.head, fixed)
    if style.bare is not None:
        there = fixed["system"] if t.style in ("add_new_line_single", "chatml", "chatglm") else message
        head = F.when(there != "", head).otherwise(F.lit(style.bare))

    def turn(m: Column, i: Column) -> Column:
        odd = i % 2 == 1
        values = fixed | {
            "role": m["role"],
            "msg": m["text"],
            "lean": F.replace(F.replace(m["text"], F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n")),
            "alt": F.when(odd, F.lit(t.sep2)).otherwise(F.lit(t.sep)),
            "tag": F.when(odd, F.lit(t.roles[1])).otherwise(F.lit(t.roles[0])),
            "round": F.when(odd, F.lit("")).otherwise(F.concat(F.lit("[Round "), (F.floor(i / 2) + (1 if t.name == "chatglm2" else 0)).cast("string"), F.lit("]" + t.sep))),
        }
        said = F.concat(_form(style.said, values), F.when(odd, F.lit(style.odd)).otherwise(F.lit("")))
        if style.first is not None:
            said = F.when(i == 0, _form(style.first, values)).otherwise(said)
        return F.when(F.coalesce(m["text"], F.lit("")) != "", said).otherwise(_form(style.open, values))

    return F.concat(head, F.array_join(F.transform(messages, turn), ""))


def conversations(turns: DataFrame, by: str = "conv_id", at: str = "turn", role: str = "role", text: str = "text", roles: tuple[str, str] = ("USER", "ASSISTANT")) -> DataFrame:
    """(by, system_message, messages) of each conversation: system turns give the message (the first one), the others
    the messages, user turns under roles[0] and the rest under roles[1]."""
    named = F.when(F.col(role) == "user", F.lit(roles[0])).otherwise(F.lit(roles[1]))
    every = turns.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), (F.col(role) == "system").alias("system"), named.alias("role"), F.col(text).alias("text")))).alias("every"))
    system = F.filter("every", lambda m: m["system"])
    rest = F.transform(F.filter("every", lambda m: ~m["system"]), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return every.select(by, F.when(F.size(system) > 0, system[0]["text"]).alias("system_message"), rest.alias("messages"))


def openai_messages(messages: Column, system_message: Column) -> Column:
    """array of struct(role, content): the system first, even turns user, odd ones assistant; an open answer is left out."""
    told = F.transform(messages, lambda m, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), m["text"].alias("content")))
    kept = F.filter(told, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    return F.concat(F.array(F.struct(F.lit("system").alias("role"), F.coalesce(system_message, F.lit("")).alias("content"))), kept)


def chat_pairs(messages: Column) -> Column:
    """array of struct(user, assistant) of each two turns; an open answer is null."""
    n = F.ceil(F.size(messages) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(messages, k * 2)["text"].alias("user"), F.get(messages, k * 2 + 1)["text"].alias("assistant"))))


def _pairs(messages: Column, f: object) -> Column:
    """The pairs before the last question, each through f(question, answer, index), joined."""
    n = F.floor((F.size(messages) - 1) / 2).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: f(messages[k * 2]["text"], messages[k * 2 + 1]["text"], k)), "")).otherwise(F.lit(""))


def _question(messages: Column) -> Column:
    """The last question: the last message at an even place."""
    return F.get(messages, (F.floor((F.size(messages) - 1) / 2) * 2).cast("int"))["text"]


def glm_history(messages: Column) -> Column:
    """Questions and answers with end marks; the first question has no user mark."""
    past = _pairs(messages, lambda q, a, k: F.concat(F.when(k > 0, F.lit("<|user|>")).otherwise(F.lit("")), q, F.lit("<|assistant|>"), a, F.lit("<|endoftext|>")))
    return F.concat(past, F.when(past != "", F.lit("<|user|>")).otherwise(F.lit("")), _question(messages), F.lit("<|assistant|>"))


def vqa_history(messages: Column, signal: str = "vqa") -> Column:
    """Question / answer lines; signal: base (the question alone), vqa or chat."""
    if signal == "base":
        return _question(messages)
    answer = {"vqa": "Short answer:", "chat": "Answer:"}[signal]
    past = _pairs(messages, lambda q, a, k: F.concat(F.lit("Question: "), q, F.lit(f" {answer} "), a, F.lit("\n")))
    return F.concat(past, F.lit("Question: "), _question(messages), F.lit(f" {answer}"))


def internlm_inputs(messages: Column, meta: Column | None = None, bos: str = "") -> Column:
    """Blocks between im_start and im_end, the meta instruction first if there is one."""
    block = lambda who, text: F.concat(F.lit(f"<|im_start|>{who}\n"), text, F.lit("<|im_end|>\n"))
    meta = F.lit("") if meta is None else F.coalesce(meta, F.lit(""))
    past = _pairs(messages, lambda q, a, k: F.concat(block("user", q), block("assistant", a)))
    return F.concat(F.lit(bos), F.when(meta != "", block("system", meta)).otherwise(F.lit("")), past, block("user", _question(messages)), F.lit("<|im_start|>assistant\n"))


def _role(role: Column, known: tuple[str, ...]) -> Column:
    """role, or an error if it is none of those known."""
    return F.when(role.isin(*known), role).otherwise(F.raise_error(F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null")))).cast("string"))


def minicpm_inputs(items: Column, image: str) -> Column:
    """Marks by role (user or assistant) and contents, the image placeholder before the first, which must be a user's;
    closed by the answer's mark. items: array of struct(role, content)."""
    mark = lambda role: F.when(_role(role, ("user", "assistant")) == "user", F.lit("<用户>")).otherwise(F.lit("<AI>"))
    lead = lambda m, i: F.when(i > 0, F.lit("")).when(m["role"] == "user", F.lit(image + "\n")).otherwise(F.raise_error(F.lit("the first role must be user")).cast("string"))
    turns = F.transform(items, lambda m, i: F.concat(mark(m["role"]), lead(m, i), m["content"]))
    return F.concat(F.array_join(turns, ""), F.lit("<AI>"))


#: What a GLM system message says about tools, and the marks of an image.
GLM_ROLES = ("system", "user", "assistant", "observation")
GLM_IMAGE = "<|begin_of_image|><|endoftext|><|end_of_image|>"
GLM_SYSTEM = "你是一个名为 GLM-4 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。"
GLM_CALL = "在调用上述函数时，请使用 Json 格式表示调用的参数。"
GLM_TOOLS = {
    "python": "当你向 `python` 发送包含 Python 代码的消息时，该代码将会在一个有状态的 Jupyter notebook 环境中执行。\n`python` 返回代码执行的输出，或在执行 60 秒后返回超时。\n`/mnt/data` 将会持久化存储你的文件。在此会话中，`python` 无法访问互联网。不要使用 `python` 进行任何网络请求或者在线 API 调用，这些在线内容的访问将不会成功。",
    "simple_browser": "你可以使用 `simple_browser` 工具。该工具支持以下函数：\n`search(query: str, recency_days: int)`：使用搜索引擎进行查询并显示结果，可以使用 `recency_days` 参数控制搜索内容的时效性。\n`mclick(ids: list[int])`：获取一系列指定 id 的页面内容。每次调用时，须选择3-10个页面。选择多个角度的页面，同时尽可能选择可信任的信息来源。考虑到部分页面是无法加载的，你也可以多打开一些可能有用的页面而不用担心内容过多。\n`open_url(url: str)`：打开指定的 URL。\n\n使用 `【{引用 id}†{引用文本}】` 来引用内容。\n\n操作步骤：1. 使用 `search` 来获得信息列表; 2. 使用 `mclick` 来获取指定 ID 页面的内容; 3. 根据获得的内容进行回复。在回复中应当引用信息来源。\n 如果用户提供了 URL，也可以用 `open_url` 直接打开页面。\n如果初次搜索结果没有找到合适的信息，也可以再次使用 `search` 进行搜索。",
    "cogview": "如果用户的请求中包含了对图像的描述，你可以使用 `cogview` 来生成图像并展示给用户。你需要向 `cogview` 发送图像描述，规则：\n- 发送给 `cogview` 的消息必须使用英语。用户的中文描述必须完全翻译为英语。\n- 应当尽可能详细地描述图像生成的需求，需求描述约 100 英文单词。\n- 保持用户原始描述的意图。不要虚构内容或者没见过的人物。\n- 如无特殊说明，所在地为中国，持有中国立场并遵循中国社会主义价值观。",
}


def glm_tools(tools: Column) -> Column:
    """The system message that tells of tools (JSON text of a list of them); null for null or an empty list.

    A tool of the type function is told by its name and definition, the types of GLM_TOOLS by their text.
    """
    listed = F.from_json(tools, "array<struct<type:string,function:string>>")
    told = F.create_map(*[F.lit(x) for kind, text in GLM_TOOLS.items() for x in (kind, f"## {kind}\n\n{text}")])

    def section(tool: Column) -> Column:
        own = F.concat(F.lit("## "), F.get_json_object(tool["function"], "$.name"), F.lit("\n\n"), codec.indented(tool["function"]), F.lit("\n" + GLM_CALL))
        unknown = F.raise_error(F.concat(F.lit("no such kind of tool: "), F.coalesce(tool["type"], F.lit("null")))).cast("string")
        return F.when(tool["type"] == "function", own).otherwise(F.coalesce(F.try_element_at(told, tool["type"]), unknown))

    return F.when(F.size(listed) > 0, F.array_join(F.concat(F.array(F.lit(GLM_SYSTEM)), F.transform(listed, section)), "\n\n"))


def glm_template(items: Column, generate: bool = True, special: bool = True, tools: Column | None = None, image: bool = False) -> Column:
    """items: array of struct(role, metadata, content), with image (boolean) as well if image is set.

    Items without content and image are left out; a role that is unknown, or a second image, raises an error. tools:
    for each item the JSON text of its tools or null (an array as long as items), told in a system message before it.
    """
    shown = lambda m: F.coalesce(m["image"], F.lit(False)) if image else F.lit(False)
    text = lambda m: F.concat(F.when(shown(m), F.lit(GLM_IMAGE)).otherwise(F.lit("")), F.coalesce(m["content"], F.lit("")))
    turn = lambda m: F.when(text(m) == "", F.lit("")).otherwise(F.concat(F.lit("<|"), _role(m["role"], GLM_ROLES), F.lit("|>"), F.coalesce(m["metadata"], F.lit("")), F.lit("\n"), text(m)))
    told = F.transform(items, lambda m, i: turn(m))
    if tools is not None:
        told = F.zip_with(glm_tool_messages(tools), told, lambda system, own: F.concat(F.coalesce(system, F.lit("")), own))
    if image:
        many = F.size(F.filter(items, shown)) > 1
        told = F.when(many, F.raise_error(F.lit("multiple images are not supported")).cast("array<string>")).otherwise(told)
    return F.concat(F.lit("[gMASK]<sop>" if special else ""), F.array_join(told, ""), F.lit("<|assistant|>" if generate else ""))


def glm_tool_messages(tools: Column) -> Column:
    """For each JSON text of tools the system message that tells of them; null stays null, and so do no tools."""
    return F.transform(tools, lambda t: F.concat(F.lit("<|system|>\n"), glm_tools(t)))


def image_tokens(prompt: Column, tiles: Column, tokens: int = 256, start: str = "<img>", context: str = "<IMG_CONTEXT>", end: str = "</img>") -> Column:
    """For each count in tiles the next <image> becomes start, context * tokens * count, end."""
    parts = F.split(prompt, "<image>")
    mark = lambda i: F.concat(F.lit(start), F.repeat(F.lit(context), (F.get(tiles, i) * tokens).cast("int")), F.lit(end))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(i <= F.size(tiles), mark(i - 1)).otherwise(F.lit("<image>")), p))), "")


def with_image(question: Column) -> Column:
    """A question with an image mark before it if it has none."""
    return F.when(F.contains(question, F.lit("<image>")), question).otherwise(F.concat(F.lit("<image>\n"), question))


def grid_placeholder(across: Column, down: Column, cell: str, start: str = "<slice>", end: str = "</slice>") -> Column:
    row = F.repeat(F.lit(cell), across)
    return F.concat(F.lit(start), F.array_join(F.array_repeat(row, down), "\n"), F.lit(end))


def prompt_and_target(prompt: Column, target: Column | None, sep: str = "<sep/>", eos: str = "</s>") -> Column:
    """prompt, separator and target; without a target, the end mark."""
    return F.concat(prompt, F.lit(sep), F.lit(eos) if target is None else target)


def with_system(turns: DataFrame, text: Column, by: str = "conv_id") -> DataFrame:
    """Turns with the system message set: a system turn before all others, in place of any there was."""
    first = turns.select(by).distinct()
    new = first.select(*[F.col(by) if c == by else F.lit(-1).cast(turns.schema["turn"].dataType).alias(c) if c == "turn" else F.lit("system").alias(c) if c == "role" else text.alias(c) if c == "text" else F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in turns.columns])
    return turns.filter(F.col("role") != "system").unionByName(new)


def appended(turns: DataFrame, message: DataFrame, by: str = "conv_id") -> DataFrame:
    """Turns and one more message for each conversation that `message` (by, role, text) names."""
    last = turns.groupBy(by).agg((F.max("turn") + 1).alias("turn"))
    return turns.unionByName(message.join(last, by).select(*[F.col(c) for c in turns.columns]))


def updated_last(turns: DataFrame, text: Column, by: str = "conv_id") -> DataFrame:
    """Turns with the text of each conversation's last one replaced."""
    last = F.col("turn") == F.max("turn").over(Window.partitionBy(by))
    return turns.withColumn("last_", last).withColumn("text", F.when(F.col("last_"), text).otherwise(F.col("text"))).drop("last_")


def replayed(turns: DataFrame, by: str = "conv_id", at: str = "turn") -> DataFrame:
    """Each turn with the texts of the turns up to it: a slice of its conversation, which is gathered once."""
    whole = turns.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.struct(*[F.col(c) for c in turns.columns]).alias("row")))).alias("rows"))
    each = whole.select(F.transform("rows", lambda r: r["row"]["text"]).alias("texts"), F.posexplode("rows").alias("place", "r"))
    return each.select("r.row.*", F.filter(F.slice("texts", 1, F.col("place") + 1), lambda t: t.isNotNull()).alias("history"))
