"""Fixed values of the domain: courts, procedural classes, laws, states, decision rules' confidences."""

# Codes and names that citations are made of.
UFS = (
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC",
    "SP", "SE", "TO",
)

COURT_CODES = ["STF", "STJ", "TST", "TSE", "STM", "TNU", "CNJ", r"TRF\s?\d", r"TRT\s?\d{1,2}", r"TRE-?[A-Z]{2}", r"TJ[A-Z]{2}", "TJDFT"]

COURT_NAMES = (
    "Supremo Tribunal Federal", "Superior Tribunal de Justiça", "Tribunal Superior do Trabalho", "Tribunal Superior Eleitoral",
    "Superior Tribunal Militar", "tribunais superiores", "Cortes Superiores", "Corte Suprema", "Superior Tribunal",
    "Supremo Tribunal", "Tribunal Pleno", "Corte Superior", "Corte Especial", "Corte", "Casa", "Tribunal", "Plenário", "Pleno",
    "Seção", "Turma", "Câmara", "Primeira Turma", "Segunda Turma", "Terceira Turma", "Quarta Turma", "Quinta Turma",
    "Sexta Turma", "Primeira Seção", "Segunda Seção", "Terceira Seção", "Subseção", "SBDI-1", "SBDI-2", "SDI-1", "SDI-2",
)

CLASS_NAMES = (
    "Recurso Especial Eleitoral", "Recurso Especial", "Recurso Extraordinário", "Recurso Ordinário Eleitoral",
    "Recurso Ordinário Trabalhista", "Recurso Ordinário", "Recurso em Habeas Corpus", "Recurso em Mandado de Segurança",
    "Recurso em Sentido Estrito", "Recurso de Revista", "Recurso de Embargos", "Recurso Inominado", "Agravo Interno",
    "Agravo Regimental", "Agravo de Instrumento", "Agravo em Recurso Especial", "Agravo em Recurso Extraordinário",
    "Agravo em Recurso Especial Eleitoral", "Agravo", "Embargos de Declaração", "Embargos de Divergência",
    "Embargos Infringentes e de Nulidade", "Embargos Infringentes", "Embargos", "Habeas Corpus", "Mandado de Segurança",
    "Mandado de Injunção", "Reclamação", "Apelação Criminal", "Apelação Cível", "Apelação", "Ação Rescisória",
    "Ação Direta de Inconstitucionalidade", "Ação Declaratória de Constitucionalidade",
    "Arguição de Descumprimento de Preceito Fundamental", "Ação Cautelar", "Ação Penal", "Cautelar Inominada Criminal",
    "Conflito de Competência", "Conflito de Jurisdição", "Suspensão de Liminar e de Sentença", "Suspensão de Liminar",
    "Suspensão de Segurança", "Tutela Cautelar Antecedente", "Revisão Criminal", "Correição Parcial", "Petição",
    "Questão de Ordem", "Inquérito", "Representação", "Ação de Investigação Judicial Eleitoral",
    "Ação de Impugnação de Mandato Eletivo", "Recurso contra Expedição de Diploma", "Registro de Candidatura", "Consulta",
    "Prestação de Contas",
)

CLASS_CODES = (
    "REsp", "RE", "AREsp", "ARE", "EREsp", "EAREsp", "REspe", "REspEl", "AREspE", "AREspEl", "AREspEI", "RESPE", "AgInt", "AgRg", "AgR", "AgReg",
    "Ag", "AI", "AIRR", "AgAIRR", "ARR", "AgARR", "RR", "RRAg", "RO", "ROT", "ReeNec", "EDcl", "ED", "EDs", "EDiv", "EI", "EInf", "E", "HC", "RHC",
    "MS", "RMS", "MI", "Rcl", "Recl", "RCL", "APL", "Ap", "ApCrim", "AR", "ADI", "ADC", "ADO", "ADPF", "AC", "AP", "CC", "CJ", "SLS", "SL", "SS",
    "Pet", "QO", "RSE", "Rp", "R-Rp", "RvC", "Inq", "TutCautAnt", "PExt",
)
CHAIN_CODES = ["E", "Ag", "R"]
PREFIX_CODES = (
    "Ag", "AgR", "AgRg", "AgInt", "E", "ED", "EDcl", "A",
)

# Codes of laws, and states by name.
LAW_CODES = (
    "CPC", "CPC/2015", "CPC/15", "CPC/73", "CPP", "CPM", "CPPM", "CLT", "CDC", "CTN", "CC", "CC/2002", "CF", "CF/88", "CF/1988", "ECA", "LINDB",
    "LEP", "CTB", "CRFB", "CRFB/88", "CRFB/1988", "NCPC",
)

STATES = {
    "ACRE": "AC", "ALAGOAS": "AL", "AMAPA": "AP", "AMAZONAS": "AM", "BAHIA": "BA", "CEARA": "CE", "DISTRITO FEDERAL": "DF",
    "ESPIRITO SANTO": "ES", "GOIAS": "GO", "MARANHAO": "MA", "MATO GROSSO": "MT", "MATO GROSSO DO SUL": "MS", "MINAS GERAIS": "MG",
    "PARA": "PA", "PARAIBA": "PB", "PARANA": "PR", "PERNAMBUCO": "PE", "PIAUI": "PI", "RIO DE JANEIRO": "RJ",
    "RIO GRANDE DO NORTE": "RN", "RIO GRANDE DO SUL": "RS", "RONDONIA": "RO", "RORAIMA": "RR", "SANTA CATARINA": "SC",
    "SAO PAULO": "SP", "SERGIPE": "SE", "TOCANTINS": "TO",
}

# Superior courts, in the order in which a mention counts
COURTS = {
    "STF": "supremo tribunal federal",
    "STJ": "superior tribunal de justica",
    "TST": "tribunal superior do trabalho",
    "TSE": "tribunal superior eleitoral",
    "STM": "superior tribunal militar",
}

# Laws, the first that fits counts; patterns over unaccented lower case
LAWS = {
    "CPC": r"processo civil|\bn?cpc\b|13\.?105",
    "CPP": r"processo penal|\bcpp\b|3\.?689",
    "CPM": r"penal militar|\bcpm\b|decreto-lei\D{0,6}1\.?001\b",
    "CDC": r"defesa do consumidor|\bcdc\b|8\.?078",
    "CE": r"codigo eleitoral|4\.?737",
    "LC64": r"complementar\D{0,8}\b64\b|\blc\D{0,4}\b64\b|inelegibilidades",
    "CLT": r"consolidacao das leis do trabalho|\bclt\b|5\.?452",
    "CF": r"constitui|\bcf\b|\bcrfb\b|carta (?:magna|da republica|politica)|lei maior",
    "CC": r"codigo civil|\bcc\b|10\.?406",
}

# Court, number, binding, beginning of the text
KNOWN_SUMULAS = [
    ("STJ", 83, False, "Não se conhece do recurso especial pela divergência"),
    ("STJ", 211, False, "Inadmissível recurso especial quanto à questão"),
    ("STJ", 443, False, "O aumento na terceira fase de aplicação da pena"),
    ("STF", 10, True, "Viola a cláusula de reserva de plenário"),
    ("TST", 331, False, "CONTRATO DE PRESTAÇÃO DE SERVIÇOS. LEGALIDADE."),
]

# Law, article, beginning of the text
KNOWN_ARTICLES = [
    ("CPC", 373, "Art. 373. O ônus da prova incumbe"),
    ("CC", 186, "Art. 186. Aquele que, por ação ou omissão"),
    ("CLT", 477, "Art. 477. Na extinção do contrato de trabalho"),
    ("CLT", 818, "Art. 818. O ônus da prova incumbe"),
    ("CLT", 896, "Art. 896 - Cabe Recurso de Revista"),
    ("CF", 5, "Art. 5º Todos são iguais perante a lei"),
    ("CF", 7, "Art. 7º São direitos dos trabalhadores"),
    ("CF", 93, "Art. 93. Lei complementar, de iniciativa"),
    ("CPP", 312, "Art. 312. A prisão preventiva"),
    ("CPM", 290, "Art. 290. Receber, preparar, produzir"),
    ("CDC", 14, "Art. 14. O fornecedor de serviços responde"),
    ("CE", 276, "Art. 276. As decisões dos Tribunais Regionais"),
    ("LC64", 1, "Art. 1º São inelegíveis"),
]

# Letters that scanners read for a digit
LOOKALIKES = ("OoDQIlLi|ZzSsGbTBgq", "0000111112255667899")

# Measured share of right decisions, by rule
CONFIDENCE = {
    "artigo_inexistente": 0.9998, "artigo_lei_fora": 0.9997, "artigo_real": 0.9999, "artigo_sem_numero": 0.5,
    "descricao_sem_correspondencia": 0.5, "descricao_unica": 0.9997, "descricao_varios": 0.9999,
    "generica": 0.9,
    "processo_ambiguo": 0.6, "processo_inventado": 0.9999, "processo_inventado_ocr": 0.9998, "processo_real": 0.9946,
    "processo_real_ocr": 0.9999, "processo_real_uf_divergente": 0.6, "processo_sem_numero": 0.5,
    "sumula_ambigua": 0.6, "sumula_inventada": 0.9999, "sumula_real": 0.9999, "sumula_sem_numero": 0.5,
    "tema_oj": 0.9999,
}
DEFAULT_CONFIDENCE = 0.5
