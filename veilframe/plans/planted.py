"""Labelled texts made from the customers: what a rule or the engine must find in them is known without looking.

Every expression is one string that Spark and DuckDB read alike, so both make the same texts. SQL
tells the truth from how a text was made, never by searching it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import Rule
from ..operators.rules import rule_findings


def _d(n: int, fill: str = "4") -> str:
    """n digits that end with the customer's key."""
    return f"lpad(CAST(c_custkey AS STRING), {n}, '{fill}')"


def _cut(text: str, *parts: tuple[int, int]) -> list[str]:
    return [f"substr({text}, {a}, {n})" for a, n in parts]


def _digit(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i}, 1) AS INT)"


_SNILS = "('112' || lpad(CAST(c_custkey AS STRING), 6, '0'))"
_SNILS_SUM = " + ".join(f"{_digit(_SNILS, i)} * {10 - i}" for i in range(1, 10))
_BBAN = "('37040044' || lpad(CAST(c_custkey AS STRING), 10, '0') || '131400')"
_MOD97 = f"((CAST(substr({_BBAN}, 1, 12) AS BIGINT) % 97 * 1000000000000 + CAST(substr({_BBAN}, 13, 12) AS BIGINT)) % 97)"
_A7, _B7, _C7 = _cut(_d(7), (1, 3), (4, 2), (6, 2))
_N = "CAST(c_custkey % 90 + 1 AS STRING)"
#: What stands before a value, the value, and what stands after it, for each rule.
RULES = {
    "phone_1": ("Звоните ", f"'+7 (912) ' || {_A7} || '-' || {_B7} || '-' || {_C7}", " днём"),
    "phone_2": ("Офис ", f"'7 (495) ' || {_d(7)}", " днём"),
    "phone_3": ("Офис ", f"'(4212) ' || {_B7} || '-' || {_C7} || '-15'", " днём"),
    "phone_4": ("Офис ", f"'495 123-' || {_B7} || '-' || {_C7}", ", днём"),
    "phone_5": ("Офис ", f"'79' || {_d(9)}", "."),
    "phone_6": ("Büro ", f"'+49 (30) ' || {_d(7)}", " Berlin"),
    "phone_7": ("Тел: ", f"'8 900 ' || {_A7} || '-' || {_B7} || '-' || {_C7}", ", днём"),
    "card_2": ("карта клиента ", "'4111 1111 1111 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')", " действует"),
    "snils_1": ("Номер ", f"substr({_SNILS}, 1, 3) || '-' || substr({_SNILS}, 4, 3) || '-' || substr({_SNILS}, 7, 3) || ' ' || lpad(CAST(({_SNILS_SUM}) % 101 % 100 AS STRING), 2, '0')", ", верно"),
    "snils_2": ("Номер ", f"'112-233-' || {_A7} || ' 95'", ", верно"),
    "snils_3": ("СНИЛС: ", _d(11), " верно"),
    "inn_person_1": ("ИНН ", _d(12), " верно"),
    "inn_org_1": ("ИНН организации ", _d(10), " верно"),
    "kpp_1": ("ИНН/КПП 7707123458/", _d(9), " верно"),
    "ogrn_1": ("ОГРН: ", _d(13), " верно"),
    "kpp_2": ("КПП ", _d(9), " верно"),
    "bank_account_1": ("IBAN ", f"'DE' || lpad(CAST(98 - {_MOD97} AS STRING), 2, '0') || substr({_BBAN}, 1, 18)", "."),
    "bik_1": ("БИК ", f"'0' || {_d(8)}", " верно"),
    "bank_account_2": ("р/с № ", _d(20), " верно"),
    "bank_account_3": ("Счета: ", f"'40702' || {_d(15)}", " и всё"),
    "contract_1": ("Договор поставки № ", f"{_d(4)} || '/А-7'", " подписан"),
    "passport_1": ("паспорт ", f"'45 10 ' || {_d(6)}", " выдан"),
    "passport_2": ("Документ ", f"'45 10 ' || {_d(6)}", " выдан"),
    "oms_1": ("полис ", _d(16), " выдан"),
    "driver_license_1": ("в/у ", f"'77 12 ' || {_d(6)}", " выдано"),
    "vehicle_plate_1": ("Машина ", "'А' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || 'ВС77'", " стоит"),
    "birth_date_1": ("дата рождения: ", "'12.03.' || CAST(1950 + c_custkey % 50 AS STRING)", ", Тверь"),
    "address_1": ("Адрес: ", f"'г. Тверь, ул. Мира, д. ' || {_N}", "; далее"),
    "address_2": ("Живёт: ", f"'ул. Большая Садовая, дом ' || {_N}", "; далее"),
    "address_3": ("Склад: ", f"'ул. Мира, ' || {_N}", "; далее"),
    "address_4": ("Склад: ", f"'Ленинский пр-т, ' || {_N}", "; далее"),
    "address_5": ("Индекс ", _d(6, "1"), ", Тверь"),
    "username_1": ("Пишите ", "'t.me/mayak_' || CAST(c_custkey AS STRING)", " днём"),
    "username_2": ("Пишите ", "'@ivan_' || CAST(c_custkey AS STRING)", " днём"),
    "secret_1": ("Ключ ", f"'-----BEGIN PRIVATE KEY-----' || {_d(9)} || '-----END PRIVATE KEY-----'", " конец"),
    "secret_2": ("Auth ", f"'Bearer abcdefghijkl' || {_d(6)}", " end"),
    "secret_3": ("Auth ", f"'eyJabcdefghijk.abcdefghijkl.abcdefg' || {_d(6)}", " end"),
    "secret_4": ("Строка ", f"'Server=db7;Password=pw' || {_d(6)}", " end"),
    "secret_5": ("Вход ", f"'password: hunter' || {_d(6)}", ", end"),
    "secret_6": ("Вход ", f"'https://x.ru/a?token=t' || {_d(6)}", " end"),
    "secret_7": ("Вход ", f"'AKIA' || {_d(16, '7')}", " end"),
    "business_1": ("Итог: ", "'зарплата ' || CAST(c_custkey AS STRING)", "; далее"),
}


def found(customer: DataFrame, rule: Rule) -> DataFrame:
    """What a rule finds in its texts: c_custkey, start, value. Every third text holds no value."""
    before, value, after = RULES[rule.name]
    text = F.expr(f"CASE WHEN c_custkey % 3 = 0 THEN 'нет ничего ' || CAST(c_custkey % 100 AS STRING) ELSE '{before}' || {value} || '{after}' END")
    rows = customer.select("c_custkey", F.explode(rule_findings(text, rule)).alias("f"))
    return rows.select("c_custkey", F.col("f.start").alias("start"), F.col("f.original").alias("value"))


def truth(name: str) -> str:
    before, value, _ = RULES[name]
    return f"SELECT c_custkey, {len(before)}::INTEGER AS start, {value} AS value FROM customer WHERE c_custkey % 3 != 0"


STEMS = "Бар Вельм Гор Дрозд Ерш Жар Зим Кар Лап Мерз Нос Орл Пест Рог Сав Тарас Уш Филат Хар Чебот Шаб Щерб Юж Яким Бирк Вороб Глух Дьяк Егор Калат Лобан Маслен Никон Осин Пугач Реш Сажин Толмач Фирс Хлеб".split()
ENDS = ("ов", "инский", "енко", "ова", "янц")
GIVEN = (("Иван", "Пётр", "Олег", "Глеб", "Павел", "Семён", "Роман", "Денис"), ("Анна", "Мария", "Ольга", "Вера", "Нина", "Дарья", "Елена", "Юлия"))
PATRONYMICS = (("Сергеевич", "Олегович", "Андреевич", "Павлович", "Игоревич"), ("Сергеевна", "Олеговна", "Андреевна", "Павловна", "Игоревна"))
PEOPLE = len(STEMS) * len(ENDS)


def _pick(words, at: str) -> str:
    """The word of a list at a place, as an expression that both engines know."""
    return "CASE " + " ".join(f"WHEN {at} = {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


_K = "c_custkey"
_S, _E = f"(CAST(floor({_K} / {len(ENDS)}) AS INT))", f"({_K} % {len(ENDS)})"
_PERSON = (
    f"SELECT c_custkey AS k, {_pick(STEMS, _S)} || {_pick(ENDS, _E)} AS s, "
    f"CASE WHEN {_E} = 3 THEN {_pick(GIVEN[1], _K + ' % 8')} ELSE {_pick(GIVEN[0], _K + ' % 8')} END AS g, "
    f"CASE WHEN {_E} = 3 THEN {_pick(PATRONYMICS[1], _K + ' % 5')} ELSE {_pick(PATRONYMICS[0], _K + ' % 5')} END AS p FROM customer WHERE c_custkey < {PEOPLE}"
)
_I, _J = "substr(g, 1, 1)", "substr(p, 1, 1)"
#: The spellings of a person; the first text (label 0) names them in full.
SPELLINGS = (
    "s || ' ' || g || ' ' || p", "g || ' ' || p || ' ' || s", "g || ' ' || s", "s || ' ' || g", f"s || ' ' || {_I} || '.' || {_J} || '.'", f"s || ' ' || {_I} || '. ' || {_J} || '.'",
    f"{_I} || '.' || {_J} || '. ' || s", f"{_I} || '. ' || {_J} || '. ' || s", f"s || ' ' || {_I} || '.'", f"s || ' ' || {_I} || {_J}", f"s || ' ' || {_I} || '.' || {_J}", "upper(s || ' ' || g || ' ' || p)",
    "lower(s || ' ' || g || ' ' || p)", f"s || ' ' || {_I} || '.' || {_J} || '.'", "s || '  ' || g || '  ' || p", "s || chr(10) || g || ' ' || p",
)


def _spelling() -> str:
    return "CASE label " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(SPELLINGS, 1)) + f" ELSE {SPELLINGS[0]} END"


def people_texts(customer: DataFrame) -> DataFrame:
    """k, label, text: 200 people in 16 spellings each, and a text that names each in full."""
    spark = customer.sparkSession
    rows = spark.sql(_PERSON.replace("FROM customer", "FROM {customer}"), customer=customer)
    labels = spark.range(len(SPELLINGS) + 1).select(F.col("id").cast("int").alias("label"))
    text = F.expr(f"CASE WHEN label = 0 THEN 'Утвердил ' || {SPELLINGS[0]} || '.' ELSE 'Согласовано, ' || {_spelling()} || ', отдел логистики.' END")
    return rows.join(F.broadcast(labels)).select("k", "label", text.alias("text"))


# Two spellings that are written alike are one variant; label 1 repeats what label 0 says.
PEOPLE_SQL = f"""
WITH person AS ({_PERSON}), t AS (SELECT k, label, 'Name' || (k + 1) || CASE WHEN label > 1 THEN '_' || label ELSE '' END AS token FROM person, range({len(SPELLINGS) + 1}) AS l(label))
SELECT k, CAST(label AS INTEGER) AS label, CASE WHEN label = 0 THEN 'Утвердил ' || token || '.' ELSE 'Согласовано, ' || token || ', отдел логистики.' END AS text FROM t
"""
RESTORED_SQL = f"""
WITH person AS ({_PERSON}), t AS (SELECT *, {_spelling()} AS x FROM person, range({len(SPELLINGS) + 1}) AS l(label))
SELECT k, CAST(label AS INTEGER) AS label, CASE WHEN label = 0 THEN 'Утвердил ' || x || '.' ELSE 'Согласовано, ' || x || ', отдел логистики.' END AS text, true AS hidden FROM t
"""

#: Texts about company, city and site number k; the first of each tells by a sign what the name is.
_COMPANY, _SITE = "'Лазур' || lower(hex(c_custkey))", "'zavod' || CAST(c_custkey AS STRING) || '.ru'"
_ENTITY = {0: ("Поставщик ООО «", _COMPANY, "» отгрузил товар"), 1: ("Счёт для ", _COMPANY, " оплачен"), 2: ("Сайт ", _SITE, " открыт")}


def entity_texts(customer: DataFrame) -> DataFrame:
    spark = customer.sparkSession
    labels = spark.range(len(_ENTITY)).select(F.col("id").cast("int").alias("label"))
    text = "CASE label " + " ".join(f"WHEN {n} THEN '{a}' || {v} || '{b}'" for n, (a, v, b) in _ENTITY.items()) + " END"
    return customer.where(f"c_custkey < {PEOPLE}").join(F.broadcast(labels)).select(F.col("c_custkey").alias("k"), "label", F.expr(text).alias("text"))


ENTITIES_SQL = (
    f"WITH t AS (SELECT c_custkey AS k, label, CASE WHEN label < 2 THEN 'Company' ELSE 'Domain' END || (c_custkey + 1) AS x FROM customer, range({len(_ENTITY)}) AS l(label) WHERE c_custkey < {PEOPLE}) "
    "SELECT k, CAST(label AS INTEGER) AS label, CASE label " + " ".join(f"WHEN {n} THEN '{a}' || x || '{b}'" for n, (a, _, b) in _ENTITY.items()) + " END AS text FROM t"
)
