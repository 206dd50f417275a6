"""Word lists and sentence patterns of the emotion score."""

# Words of conflict, of climax and of strong feeling. One-character words count only as whole words.
CONFLICT = [
    "住手", "不可能", "原来是你", "你竟然", "我怎么没想到", "背叛", "欺骗", "谎言", "真相", "复仇", "报仇", "杀", "死", "血", "恨",
    "疯子", "混蛋", "畜生", "滚", "闭嘴", "放肆", "大胆", "竟敢", "离婚", "分手", "取消婚约", "退婚", "打", "推倒", "抓住", "放开我",
    "救命", "报警", "坐牢", "判刑", "反转", "没想到", "居然", "竟然", "终于", "这一刻", "不可能的事", "全部", "一切", "从来", "一直",
]
INTENSE = [
    "爱", "恨", "愤怒", "崩溃", "绝望", "心碎", "痛哭", "狂笑", "尖叫", "颤抖", "震惊", "难以置信", "天哪", "上帝", "老天", "苍天", "不",
    "为什么", "怎么可能", "怎么会", "别", "不要", "不行", "太好了", "太棒了", "终于等到", "对不起", "原谅我", "我错了", "后悔", "我爱你",
    "我恨你", "再见了", "骗子", "虚伪", "恶心", "可怕", "恐怖",
]
CLIMAX = [
    "最后的机会", "唯一的选择", "没有退路", "生死攸关", "千钧一发", "命悬一线", "真相大白", "水落石出", "尘埃落定", "从此以后", "永远",
    "发誓", "承诺", "开始", "结束", "终结", "赢了", "输了", "胜利", "失败",
]

# Patterns of exclamations and rhetorical questions.
PATTERNS = [
    r"！{2,}", r"？{2,}", r"[！？]{2,}", r"^[！？\s]+", r"难道.*[？！]$", r"怎么.*[？！]$", r"难道.*[！]$", r"居然.*[！？]", r"竟然.*[！？]",
    r"简直.*[！？]", r"到底.*[？]", r"究竟.*[？]", r"莫非.*[？]", r"该不会.*[？]", r"不会吧.*[？！]", r"天哪", r"我的天", r"我的 god", r"no+",
]
