"""Values that must equal the public behaviour this library matches.

Word lists, patterns and constants only; no logic.
"""

# --- fixed values: question planning -------------------------------------
QUESTION_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "based", "by", "for", "from", "in",
    "into", "is", "of", "on", "or", "paper", "papers", "related", "review",
    "study", "survey", "the", "to", "with", "write",
    "帮", "我", "写", "一", "篇", "相关", "综", "述", "的", "和", "与", "及",
    "研究", "调研", "综述", "论文", "领域", "请", "生成",
]
PERSPECTIVES = [
    "theoretical foundations",
    "main methods",
    "datasets and metrics",
    "applications",
    "limitations and controversies",
    "recent trends",
]

# --- fixed values: news risk lexicons ------------------------------------
NEGATIVE_TERMS = [
    "违约", "逾期", "欠款", "债务", "偿债", "流动性", "展期", "兑付", "违约风险",
    "被执行", "失信", "限制高消费", "冻结", "查封", "拍卖", "司法", "诉讼", "仲裁",
    "破产", "重整", "清算", "停产", "停工", "亏损", "下滑", "下降", "资不抵债",
    "处罚", "罚款", "行政处罚", "监管函", "警示函", "问询函", "立案", "调查",
    "质押", "担保", "代偿", "担保责任", "保证责任", "风险提示", "经营困难",
    "裁员", "撤销", "吊销", "注销", "失联", "异常经营", "经营异常",
]
POSITIVE_TERMS = [
    "中标", "签约", "战略合作", "融资", "投资", "增资", "扩产", "投产", "入选",
    "获奖", "补贴", "专项资金", "高新技术", "专利", "上市", "盈利", "增长", "同比增长",
]
FINANCIAL_TERMS = [
    "营业收入", "营收", "净利润", "利润", "现金流", "资产负债率", "资产", "负债",
    "应收账款", "债券", "票据", "贷款", "利率", "授信", "融资租赁", "担保余额",
    "审计", "年报", "半年报", "财务", "偿债能力", "信用评级", "评级", "主体评级",
    "毛利率", "净资产", "所有者权益", "流动资产", "流动负债",
]
NOTICE_TERMS = [
    "公示", "公告", "通告", "名单", "附件", "序号", "单位名称", "企业名称", "项目名称",
    "拟支持", "拟认定", "拟推荐", "入库", "备案", "申报", "准予注册", "统一社会信用代码",
]
LIST_MARKERS = ["企业名称", "单位名称", "统一社会信用代码", "序号", "名单", "公示表"]
COMPANY_WORD = r"(?:公司|企业|集团|厂|单位)"

# --- fixed values: news patterns -----------------------------------------
BAD_PAGE = (
    r"云安全平台检测到|访问行为存在异常|触发WAF防护|事件ID|客户端IP|"
    r"HTTP ERROR|页面没有找到|无法处理此请求|404 Not Found|502 Bad Gateway|"
    r"Service Temporarily Unavailable|Access Denied|Forbidden|您当前的访问行为存在异常"
)
BOILERPLATE = [
    r"扫一扫在手机打开当前页.*$",
    r"站点地图.*?违法和不良信息举报中心.*$",
    r"文章内容仅供参考。?",
    r"投资者据此操作，风险自担。?",
    r"据此操作，风险自担。?",
    r"若需转载本网稿件，请致电[:：]?.*?。",
    r"违反上述声明者，本网将追究其相关法律责任。?",
    r"特别提醒：如果我们使用了您的图片.*?撤下您的作品。?",
    r"免责声明[:：]?.{0,300}?(?:风险自担|仅供参考)。?",
    r"版权声明[:：]?.{0,300}?(?:法律责任|联系我们)。?",
    r"责任编辑[:：][^。；;\n]{0,40}",
    r"编辑[:：][^。；;\n]{0,40}",
    r"来源[:：][^。；;\n]{0,60}",
]
URL_PATTERN = r"(?i)https?://\S+|www\.\S+"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
LONG_HEX_PATTERN = r"(?<![A-Za-z0-9])[a-fA-F0-9]{20,}(?![A-Za-z0-9])"
PHONE_PATTERN = r"(?:联系电话|联系方式|咨询电话|电话|传真)[:：]?\s*[0-9\-—\s]{6,30}"
AMOUNT_PATTERN = r"\d+(?:\.\d+)?\s*(?:亿|万|万元|亿元|元|人民币|美元)"
DATE_PATTERN = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
ID_COLUMNS = ["duty_id", "id", "ID", "company_id", "enterprise_id", "credit_code", "企业ID"]
LABEL_COLUMNS = ["is_replace", "label", "y", "target", "违约", "是否违约"]

# --- fixed values: identifiers -------------------------------------------
ORCID_PATTERN = r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])"
ORCID_PREFIX = "https://orcid.org/"
DOI_PREFIX_PATTERN = r"(?i)^(https://doi\.org/|http://doi\.org/|doi\.org/|doi:)"
TOKEN_PATTERN = r"([A-Za-z0-9_]+|[一-鿿])"
PHRASE_PATTERN = r"([A-Za-z][A-Za-z0-9_\-]*(?:\s+[A-Za-z][A-Za-z0-9_\-]*){0,4})"
