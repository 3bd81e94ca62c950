"""Small fixed inputs (fixed values: labelled questions, a booking, templates)."""

from __future__ import annotations

import os

S, A = "SIMPLE_RAG", "AGENTIC_RAG"
ROUTES = [
    ("你好", S),
    ("医院几点上班？", S),
    ("我想挂号", S),
    ("帮我取消明天上午的预约", S),
    ("神经内科在门诊楼几楼？", S),
    ("脑梗塞的前兆症状有哪些？", S),
    ("做脑电图检查之前需要空腹吗", S),
    ("流感疫苗什么时候打好", S),
    ("神经内科和心内科都看什么病？", A),
    ("请分别介绍一下体检中心和神经内科", A),
    ("脑梗和脑出血有什么区别？", A),
    ("帮我读一下体检中心那个文档的原文", A),
    ("知识库里都有哪些文件？", A),
    ("总结一下医院的就诊须知", A),
    ("我先做个体检，再根据结果挂对应的科室，该怎么安排？", A),
    ("挂号需要带什么？体检需要空腹吗？", A),
    ("失眠已经持续一个月了应该去看哪个科室比较合适", S),
    ("宝宝最近总是半夜发烧咳嗽应该去看什么科室呢", S),
    ("我要做一个全身体检同时还想咨询一下失眠的治疗方案", A),
]
#: The first sentence of a text, without its mark.
FIRST = r"[^.!?\n]*"
#: A similarity that only some questions' chunks reach.
NEAR = 0.9
BOOKING = "id long, username string, idCard string, department string, date string, time string, doctorName string"
BOOKINGS = [
    (1, "张三", "123456789012345678", "内科", "2025-04-14", "上午", "张医生"),
    (2, "李四", "223456789012345678", "外科", "2025-04-15", "下午", "王医生"),
    (3, "李四", "223456789012345678", "外科", "2025-04-15", "下午", "赵医生"),
    (4, "王五", None, "内科", "2025-04-16", "上午", None),
]
REQUESTS = [
    (1, "张三", "123456789012345678", "内科", "2025-04-14", "上午", "李医生"),
    (2, "张三", "123456789012345678", "内科", "2025-04-14", "下午", "张医生"),
    (3, "张三", "123456789012345678", "内科", "2025-04-14", "下午", "李医生"),
    (4, "王五", None, "内科", "2025-04-16", "上午", None),
    (5, "李四", "223456789012345678", "外科", "2025-04-15", "下午", "王医生"),
]
TEMPLATE = "你是{{username}}的助手，今年{{age}}岁。{{message}}"
DATED = "{{message}} （今天是 {{current_date}}）"
FILES = [("a.txt", "alpha beta\n"), ("b.md", "# gamma\n\ndelta"), ("c.csv", "no"), ("sub/d.txt", "epsilon")]


def write_files(path: str) -> None:
    for name, text in FILES:
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
