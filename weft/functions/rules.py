"""Word lists, rules and tables that results depend on."""

from __future__ import annotations

#: Spellings of one term, after normalisation.
ALIASES = {
    "llms": "llm",
    "large language model": "llm",
    "large language models": "llm",
    "retrieval augmented generation": "rag",
    "retrieval-augmented generation": "rag",
    "rag-based approach": "rag",
    "rag-based approaches": "rag",
    "gpt-3": "gpt",
    "gpt-4": "gpt",
    "gpt-3.5": "gpt",
    "gpt3": "gpt",
    "gpt4": "gpt",
    "chatgpt": "gpt",
    "bert": "bert",
    "bert-base": "bert",
    "roberta": "roberta",
    "xlnet": "xlnet",
    "t5": "t5",
    "transformer": "transformer",
    "transformers": "transformer",
    "attention mechanism": "attention",
    "self-attention": "attention",
    "multi-head attention": "attention",
    "word embedding": "word embedding",
    "word embeddings": "word embedding",
    "word2vec": "word embedding",
    "glove": "word embedding",
    "fasttext": "word embedding",
    "named entity recognition": "ner",
    "ner": "ner",
    "machine translation": "machine translation",
    "mt": "machine translation",
    "natural language inference": "nli",
    "nli": "nli",
    "text classification": "text classification",
    "sentiment analysis": "sentiment analysis",
    "question answering": "question answering",
    "qa": "question answering",
    "summarization": "summarization",
    "text summarization": "summarization",
    "information retrieval": "information retrieval",
    "ir": "information retrieval",
    "knowledge graph": "knowledge graph",
    "knowledge graphs": "knowledge graph",
    "kg": "knowledge graph",
    "convolutional neural network": "cnn",
    "cnns": "cnn",
    "recurrent neural network": "rnn",
    "rnns": "rnn",
    "long short-term memory": "lstm",
    "lstm": "lstm",
    "generative adversarial network": "gan",
    "gans": "gan",
    "variational autoencoder": "vae",
    "vaes": "vae",
    "graph neural network": "gnn",
    "gnns": "gnn",
    "reinforcement learning": "reinforcement learning",
    "rl": "reinforcement learning",
    "deep learning": "deep learning",
    "dl": "deep learning",
    "transfer learning": "transfer learning",
    "few-shot learning": "few-shot learning",
    "zero-shot learning": "zero-shot learning",
    "contrastive learning": "contrastive learning",
    "self-supervised learning": "self-supervised learning",
    "semi-supervised learning": "semi-supervised learning",
    "active learning": "active learning",
    "meta-learning": "meta-learning",
    "federated learning": "federated learning",
    "bleu score": "bleu",
    "bleu": "bleu",
    "rouge score": "rouge",
    "rouge": "rouge",
    "f1 score": "f1",
    "f1-score": "f1",
    "accuracy": "accuracy",
    "precision": "precision",
    "recall": "recall",
    "auc": "auc",
    "auc-roc": "auc",
    "mean average precision": "map",
    "map": "map",
    "mean squared error": "mse",
    "mse": "mse",
    "root mean squared error": "rmse",
    "rmse": "rmse",
    "randomized controlled trial": "rct",
    "randomised controlled trial": "rct",
    "quasi-experiment": "quasi-experimental",
    "quasi experiment": "quasi-experimental",
    "systematic review": "systematic review",
    "meta-analysis": "meta-analysis",
    "meta analysis": "meta-analysis",
    "ablation study": "ablation study",
    "ablation studies": "ablation study",
    "case study": "case study",
    "case studies": "case study",
    "cross-validation": "cross-validation",
    "cross validation": "cross-validation",
    "k-fold cross-validation": "cross-validation",
    "statistical significance": "statistical significance",
    "p-value": "statistical significance",
    "p value": "statistical significance",
    "imagenet": "imagenet",
    "coco": "coco",
    "mnist": "mnist",
    "cifar-10": "cifar",
    "cifar10": "cifar",
    "squad": "squad",
    "glue": "glue",
    "superglue": "superglue",
    "common crawl": "common crawl",
    "wikipedia": "wikipedia",
}
#: Kinds of limitation by what their texts say, in order.
LIMITATION_TYPES = {
    "sample_size": ["sample size", "small sample", "样本量", "样本不足"],
    "single_dataset": ["single dataset", "one dataset", "单数据集", "数据集单一"],
    "short_duration": ["short duration", "short-term", "短期", "时间短"],
    "lack_control_group": ["control group", "lack of control", "缺乏对照"],
    "generalizability": ["generaliz", "外部效度", "推广性", "可推广"],
    "measurement_bias": ["measurement bias", "self-report", "测量偏差"],
    "method_limitation": ["methodology", "method limitation", "方法局限"],
    "domain_limitation": ["domain", "context specific", "领域局限"],
}
#: What a question asks for, in order.
INTENTS = {
    "review_generation": ["综述", "文献综述", "研究现状"],
    "limitation_analysis": ["不足", "局限", "limitation", "缺陷", "短板"],
    "method_compare": ["比较", "对比", "区别", "优劣", "compare"],
    "method_analysis": ["方法", "method", "模型", "实验设计", "方法论"],
    "finding_summary": ["发现", "结论", "结果", "finding", "成果"],
    "gap_analysis": ["gap", "空白", "未来工作", "创新机会", "研究方向"],
    "innovation_generation": ["创新", "创新点", "选题", "论文题目"],
    "evidence_check": ["支撑", "证据", "是否能证明", "支持"],
    "trend_analysis": ["趋势", "演进", "年份", "近年来", "发展"],
}
#: Fields of evidence that an intent prefers.
INTENT_FIELDS = {
    "summary": ["finding", "topic", "method"],
    "limitation_analysis": ["limitation", "future_work"],
    "method_analysis": ["method", "data_or_sample", "finding"],
    "method_compare": ["method", "finding", "limitation"],
    "finding_summary": ["finding", "topic"],
    "gap_analysis": ["future_work", "limitation", "finding"],
    "evidence_check": ["source_quote", "finding"],
    "trend_analysis": ["topic", "finding", "method"],
    "innovation_generation": ["future_work", "limitation", "finding"],
    "review_generation": ["finding", "topic", "method"],
}
#: Gates as (name, least score, operator, required).
GATES = (
    ("scope_guard", 1.0, "==", True),
    ("citation_coverage", 0.8, ">=", True),
    ("report_traceability", 0.8, ">=", True),
    ("innovation_specificity", 0.7, ">=", False),
    ("generic_text", 0.8, ">=", False),
    ("redaction", 1.0, "==", True),
)
#: Words that carry no information, for the density of a chunk.
STOPWORDS = "the a an is are was were in on at to for of with and or but not".split()
#: Weights of a chunk's quality.
CHUNK_WEIGHTS = {"length": 0.25, "density": 0.25, "structure": 0.20, "language": 0.15, "noise": 0.15}
#: Signs of formulas.
FORMULA_SIGNS = "∑∫∂∇αβγδεζηθ∈∉⊂⊃∪∩≈≠≤≥∞±×÷"
#: Sources of records, better ones higher.
SOURCE_PRIORITY = {"openalex": 4, "semantic_scholar": 3, "arxiv": 2, "europepmc": 1}
#: Weights of strengths of evidence.
STRENGTH_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}
#: Headings by the section that they open.
HEADINGS = {
    "abstract": ["abstract", "摘要"],
    "introduction": ["introduction", "引言", "导言"],
    "related_work": ["related work", "相关工作", "文献综述"],
    "background": ["background", "背景", "preliminary", "preliminaries"],
    "method": [
        "method", "方法", "methodology", "方法论", "approach", "approaches", "experiment", "实验", "experiments", "model", "模型", "estimation", "估计", "simulation", "仿真", "simulations",
        "data analysis", "proposed method", "proposed model", "simulation settings", "model selection", "模型选择", "model estimation", "数据分析",
    ],
    "result": ["result", "结果", "results", "simulation results"],
    "discussion": ["discussion", "讨论"],
    "conclusion": ["conclusion", "结论", "conclusions"],
    "limitation": ["limitation", "局限", "limitations"],
    "future_work": ["future work", "未来工作", "future direction"],
    "acknowledgment": ["acknowledgment", "致谢"],
    "reference": ["reference", "参考文献", "references"],
    "appendix": ["appendix", "附录"],
}
#: Tokens of a context by section, in the order in which sections are taken.
SECTION_BUDGETS = {"abstract": 800, "introduction": 1200, "method": 1200, "result": 1800, "discussion": 1500, "conclusion": 1000, "limitation": 800, "future_work": 600, "related_work": 800, "background": 800}
SECTION_ORDER = (*SECTION_BUDGETS, "body", "")

#: How much a field counts in word search.
FIELD_WEIGHTS = {"abstract": 3.5, "title": 2.0, "keywords": 2.0, "concepts": 1.0, "venue": 0.5}

#: Sections whose chunks have a kind of their own, all others being body; and those whose chunks may be short.
OWN_KIND = ("abstract", "method", "result", "discussion", "limitation", "conclusion", "reference", "appendix")
SHORT_SECTIONS = ("title", "abstract")
