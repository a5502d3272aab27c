"""Labelled lines on which the field is trained: written from templates by a seeded generator, bounded in number.

A line is a list of parts; literal text is not secret, a part made by ``secret`` is. Look-alikes fill the same
shapes into places that grant nothing.
"""

from __future__ import annotations

import base64
import random
import string

#: Number of generated lines (a documented bound of the training sample); half as many with plain secrets come on top.
TRAINING_LINES = 12000

_ALNUM = string.ascii_letters + string.digits
_B64 = _ALNUM + "+/"

# Parts of names and sentences of the generator.
SECRET_NAMES = "password passwd pwd pass secret token apiKey api_key API_KEY accessKey access_token auth_token authToken clientSecret CLIENT_SECRET privateKey licenseKey signingKey webhookSecret dbPassword db_pass adminPw rootPass smtpPassword PGPASSWORD MYSQL_PWD SECRET_KEY SERVICE_TOKEN bearer passphrase key credential credentials auth AccountKey SharedAccessKey x_api_key TOKEN PASSWORD encryptionKey jwtSecret botToken appSecret MasterKey APIKEY PRIVATE_TOKEN sshPassphrase Passwort mot_de_passe contraseña".split()
PUBLIC_NAMES = "sha256 sha1 md5 checksum digest integrity etag commit traceId trace_id requestId revision fingerprint publicKey public_key build buildId contentHash fileHash blob treeHash spanId correlationId nonce version baseline resolved gitSha imageDigest cacheKeyHash".split()
PLAIN_NAMES = "name title path file region owner layer kind url endpoint repo model channel target description id label status component".split()
HOLDERS = "xxxxxxxxxxxx|XXXXXXXX|your-api-key-here|YOUR_API_KEY|YOUR_TOKEN|REPLACE_ME|changeme|<API_KEY>|<password>|insert-key-here|example|placeholder|********|****|sk-****|ghp_****|...|todo|REDACTED|[redacted]|<your-token>|none|my-secret-name|dummy-token|xxxx-xxxx-xxxx|enter-password-here|00000000|null".split("|")

# Fixed values of plain secrets and their look-alikes: names of what people choose, common words, and what stands there instead.
CHOSEN_NAMES = "password passwd pwd pass passphrase dbPassword db_pass adminPw rootPass smtpPassword DB_PASSWORD MYSQL_PWD PGPASSWORD ADMIN_PASSWORD sshPassphrase Passwort contraseña user_password".split()
CONSTANT_NAMES = "PASSWORD DB_PASSWORD MYSQL_PWD PGPASSWORD ADMIN_PASSWORD ROOT_PASSWORD SSH_PASSPHRASE PASSWD SMTP_PASS PWD".split()
COMMON = "sunshine dragon monkey summer winter orange purple garden window silver golden butter coffee battery horse correct staple mountain river tiger flower pepper ginger cookie hammer rocket planet castle forest ocean velvet copper marble candle lantern harbor meadow pencil guitar violin pocket ladder basket saddle anchor falcon turtle rabbit welcome letmein princess football shadow master qwerty secret hello freedom whatever".split()
INSTEAD = "string str text int number boolean bool any None null true false undefined nil required optional hidden input value data field req body self this user form options config props params result response row await new process get".split()
PROSE = "must be at least eight characters long|is required|is missing or invalid|has expired, please sign in again|does not match the confirmation|was changed by an administrator|should never be logged|cannot be empty|is read at start|field is hidden until the form is valid|to continue with the next step|for every new account|and never share it with others|is stored in the vault".split("|")


class Lines:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, options):
        return self.r.choice(options)

    def chars(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(low, high or low)))

    def syllables(self) -> str:
        return "".join(self.pick("bdfgklmnprstvz") + self.pick("aeiou") for _ in range(self.r.randint(2, 5)))

    def word(self) -> str:
        return self.pick([self.syllables(), self.syllables(), self.pick("river stone cloud order user batch report ledger queue profile alert store market account channel index cache review session digest token key".split())])

    def camel(self) -> str:
        return self.word() + self.word().capitalize()

    def name(self) -> str:
        return self.pick([self.word, self.camel, lambda: f"{self.word()}_{self.word()}", lambda: self.word().capitalize() + self.word().capitalize()])()

    def const(self) -> str:
        return f"{self.word()}_{self.word()}".upper()

    def host(self) -> str:
        return f"{self.pick('db api cache mq git smtp idp www'.split())}.{self.word()}.{self.pick('example test invalid internal.example com io net'.split())}"

    def mixed(self, low: int, high: int | None = None, alphabet: str = _ALNUM) -> str:
        while True:
            t = self.chars(alphabet, low, high)
            if any(c.isdigit() for c in t) and any(c.islower() for c in t) and any(c.isupper() for c in t):
                return t

    def hexa(self, *sizes: int) -> str:
        return self.chars("0123456789abcdef", self.pick(sizes))

    def human(self) -> str:
        """A password that a person chose."""
        a, b, mark = self.word(), self.word(), self.pick("-_.!#$%+")
        return self.pick([f"{a.capitalize()}{mark}{b}{self.r.randint(10, 9999)}", f"{self.syllables()}{b.upper()}{self.r.randint(10, 99)}", f"{a}{self.r.randint(100, 99999)}{self.pick('!#$')}", self.mixed(10, 22, _ALNUM + "!%*_-+")])

    def user(self) -> str:
        w, d = self.word(), self.chars(string.digits, 0, 2)
        return self.pick([w, w + d, f"{w}_{self.word()}{d}", f"{self.chars(string.ascii_lowercase, 2)}_{w}{d}", "admin", "root", "app"])

    def marked(self, q: str) -> str:
        """A password with marks anywhere, written as a literal in the quotes ``q``."""
        t = self.chars("-!#$%^&*~@?|.+/()[]_", 0, 2) + self.mixed(8, 18, _ALNUM + "!%*_-+@?|&#()[]\\" + q)
        return t.replace("\\", "\\\\").replace(q, "\\" + q)

    def machine(self) -> str:
        """A key that a service issued."""
        kind = self.r.randrange(13)
        if kind < 4:
            prefix = self.pick("ghp_ gho_ ghs_ glpat- npm_ sk- sk-proj- sk-svc- rk_live_ sk_live_ tok_ hf_ xoxb-1234567890- acme_live_ shp-test- mvx. ub-prod- ktr-".split())
            return prefix + self.mixed(20, 44)
        if kind == 4:
            return self.pick(["AKIA", "ASIA"]) + self.chars(string.ascii_uppercase + string.digits, 16)
        if kind == 5:
            return "AIza" + self.mixed(35, alphabet=_ALNUM + "-_")
        if kind == 6:
            return self.mixed(40, 60, _B64)
        if kind == 7:
            return self.hexa(20, 24, 32, 40, 64)
        if kind == 8:
            return self.mixed(24, 50)
        if kind == 9:
            part = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
            return f"{part('{\"alg\":\"HS256\",\"typ\":\"JWT\"}')}.{part('{\"sub\":\"' + self.word() + '\",\"iat\":' + self.chars(string.digits, 10) + '}')}.{self.mixed(43, alphabet=_ALNUM + '-_')}"
        if kind == 10:
            return f"SG.{self.mixed(22)}.{self.mixed(43, alphabet=_ALNUM + '-_')}"
        if kind == 11:
            return "-".join(self.chars(string.ascii_uppercase + string.digits, self.pick([4, 8, 10, 12])) for _ in range(3))
        return self.mixed(64, 88, _B64) + self.pick(["", "=", "=="])

    def secret(self):
        return (self.pick([self.human, self.machine, self.machine])(),)

    def password(self):
        return (self.pick([self.human, self.human, lambda: self.hexa(20, 24, 32), lambda: self.mixed(12, 24)])(),)

    def pem(self, header: str, newline: str):
        body = newline.join(self.chars(_B64, 64) for _ in range(self.r.randint(1, 4))) + newline + self.chars(_B64, 30) + "=="
        return (f"-----BEGIN {header}-----{newline}{body}{newline}-----END {header}-----",)

    def positive(self) -> list:
        q, w, n, s = self.pick("\"'`"), self.word(), self.pick(SECRET_NAMES), self.secret()
        q2, p, m = self.pick("\"'"), self.password(), self.machine
        if self.r.random() < 0.35:
            n = self.pick([f"{w}_{n}", f"{w.upper()}_{n.upper()}", w + n[0].upper() + n[1:]])
        m = (m(),)
        a = self.r.randrange(41)
        if a == 0:
            return [f"{n} = {q}", s, q]
        if a == 1:
            return [f"const {n} = {q}", s, f"{q};"]
        if a == 2:
            return [f"{n}: ", s]
        if a == 3:
            return [f"{n}={'' if self.r.random() < 0.5 else q2}", *([s] if True else []), q2 if self.r.random() < 0.5 else ""]
        if a == 4:
            return [f'{{"{n}": "', s, f'", "{w}": {self.r.randint(1, 99)}}}']
        if a == 5:
            return [f'<property name="{n}" value="', s, '"/>']
        if a == 6:
            return [f"const {w} = new {self.name()}Client({{ {self.pick(['apiKey', 'token', 'auth', 'key', 'secret', 'password'])}: {q}", s, f"{q}, retries: {self.r.randint(0, 9)} }})"]
        if a == 7:
            return [f"fetch(url, {{ headers: {{ {self.pick(['Authorization', 'authorization'])}: {q}{self.pick(['Bearer', 'token', 'Token'])} ", m, f"{q} }} }})"]
        if a == 8:
            return [f"req.set({q2}{self.pick(['Authorization', 'X-Api-Key', 'PRIVATE-TOKEN'])}{q2}, {q2}", m, f"{q2})"]
        if a == 9:
            pair = base64.b64encode(f"{w}:{p[0]}".encode()).decode()
            return [self.pick([f"req.set('Authorization', 'Basic ", "headers: { Authorization: 'Basic "]), (pair,), self.pick(["')", "' }"])]
        if a == 10:
            return [f"{self.pick(['url: ', 'const db = connect(' + q, 'Database: ', 'DATABASE_URL=', ''])}{self.pick('postgres mysql mongodb+srv postgresql+asyncpg amqps https ftp'.split())}://{self.pick([w + self.chars(string.digits, 1), self.user()])}:", p, f"@{self.host()}{self.pick(['', ':8443', ':5432'])}/{self.word()}{self.pick(['', q + ');'])}"]
        if a == 11:
            return [f"{self.pick(['const db = connect(' + q, 'CACHE=', 'Database: '])}redis://:", p, f"@{self.host()}:6379/{self.r.randint(0, 3)}"]
        if a == 12:
            return [f"let {w}Url = URL(string: \"https://{self.host()}/v1/{w}?{self.pick('access_token key api_key token sig'.split())}=", m, '")!']
        if a == 13 and self.r.random() < 0.4:
            return [f"curl {self.pick(['-s ', '-sS ', ''])}-u {w}:", p, f" https://{self.host()}/{self.word()}"]
        if a == 13:
            return [f"curl https://{self.host()}/{w}?{self.pick('access_token key api_key token'.split())}=", m]
        if a == 14:
            return [f"Server={self.host()};Database={w};Uid=svc_{w};{self.pick(['Pwd', 'Password'])}=", p, ";Pooling=true"]
        if a == 15:
            return [f"DefaultEndpointsProtocol=https;AccountName={w};AccountKey=", (self.mixed(86, alphabet=_B64) + "==",)]
        if a == 16:
            return [f"os.environ[{q2}{self.const()}{q2}] = {q2}", s, q2]
        if a == 17:
            return [f"const t = process.env.{self.const()} {self.pick(['??', '||'])} {q2}", s, q2]
        if a == 18:
            return [f"{n} = os.getenv({q2}{self.const()}{q2}, {q2}", s, f"{q2})"]
        if a == 19:
            return [f"{w}.login({q}{self.word()}{q}, {q}", p, f"{q})"]
        if a == 20:
            return [f"ds.setUser({q}{w}{q}); ds.setPassword({q}", p, f"{q});"]
        if a == 21:
            return [f"{self.camel()}(); {self.pick(['//', '#', '/*'])} old {self.pick(['key', 'token', 'password'])} was ", s, self.pick([" rotate after launch", " until we rotate", " */", ""])]
        if a == 22:
            whole = m[0] if len(m[0]) > 16 else self.mixed(30)
            k = self.r.randint(6, len(whole) - 6)
            return [f"const k = {q2}", (whole[:k],), f"{q2} + {q2}", (whole[k:],), f"{q2}; {w}.use(k)"]
        if a == 23:
            return [f"{self.pick(['Passwort für', 'Password for', 'Contraseña de', 'Mot de passe pour'])} {w}: ", p]
        if a == 24:
            return [f"Le mot de passe du compte {w} est « ", p, " »."]
        if a == 25:
            return [f"La contraseña de {w} es ", p, "."]
        if a == 26:
            return [f"Sign in as {w} {self.pick(['with the password', 'with password', 'using password'])} ", p, f" {self.pick(['if the session expired', 'before you start', 'and continue'])}."]
        if a == 27:
            return [f"When you call the {w} service, send the {self.pick(['key', 'token'])} ", m, " in the header."]
        if a == 28:
            return [f"credentials = {w} / ", p]
        if a == 29:
            return [f"{self.pick(['user', 'login', 'account'])} {w}, password ", p]
        if a == 30:
            return [f"The {self.pick(['vault', 'archive', 'store'])} opens with the passphrase ", ("-".join(self.word() for _ in range(self.r.randint(3, 5))),), self.pick([".", ""])]
        if a == 31:
            return [f'args: {{"url": "https://{self.host()}/{w}", "auth": "', s, '"}']
        if a in (32, 33, 34):
            head = self.pick(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"])
            newline = self.pick(["\n", "\\n"])
            before, after = self.pick([("", ""), (f"const {self.camel()} = `", "`;"), (f'"{self.pick(["private_key", "tlsKey", "signing_pem"])}": "', '"')])
            return [before, self.pem(head, newline), after]
        if a == 35:
            return [f"--{self.pick(['password', 'token', 'api-key', 'secret'])}{self.pick([' ', '='])}", s]
        if a == 36:
            return [f"{self.pick(['export ', ''])}{self.const()}_{self.pick(['SECRET', 'TOKEN', 'KEY', 'PASSWORD'])}=", s, self.pick(["", f" ./run.sh --{w}", f" psql -h {self.host()} -U app {w}"])]
        if a == 37:
            return [f"Use {self.pick(['token', 'API key', 'the key', 'access token'])} ", m, f" for {w}."]
        if a == 38:
            return [f"{n} {self.pick(['is', '=>', ':='])} {self.pick(['', q])}", s]
        if a == 39:
            return [f"{self.pick(['(', '', '- ', '['])}{self.pick('temporary temp current new old shared internal staging rotated demo'.split())}{self.pick([')', ':', ' value', ']', ' one:'])} ", m, self.pick(["", "", ".", f" ({w})"])]
        return [f"{self.pick(['username', 'user'])}: {w}, {self.pick(['password', 'pass', 'pwd'])}: {q2}", p, q2]

    def negative(self) -> list:
        q, w, n = self.pick("\"'`"), self.word(), self.pick(SECRET_NAMES)
        q2, pub, hold = self.pick("\"'"), self.pick(PUBLIC_NAMES), self.pick(HOLDERS)
        public = self.pick([lambda: self.hexa(32, 40, 64, 20, 24), lambda: self.mixed(40, 64, _B64), lambda: self.mixed(20, 40)])()
        uuid = "-".join(self.hexa(k) for k in (8, 4, 4, 4, 12))
        if self.r.random() < 0.35:
            n = self.pick([f"{w}_{n}", f"{w.upper()}_{n.upper()}", w + n[0].upper() + n[1:]])
        options = [
            lambda: f"{pub} = {q}{public}{q}",
            lambda: f"{pub}: {self.pick(['sha256:', 'sha1:', 'md5:', ''])}{public}",
            lambda: f'"integrity": "sha512-{self.mixed(86, alphabet=_B64)}=="',
            lambda: f'const pinned = "{self.hexa(40)}"; // commit of {w}',
            lambda: f"const {self.pick(['traceId', 'requestId', 'id', 'sessionId'])} = {q2}{uuid}{q2}",
            lambda: f"{self.pick(['Baseline commit', 'commit', 'Reverts', 'since revision', 'Merge'])} {self.hexa(40, 7, 12)}{self.pick(['.', '', ' into main'])}",
            lambda: f"background: url(data:image/png;base64,{self.mixed(40, 90, _B64)})",
            lambda: f"ssh-{self.pick(['ed25519', 'rsa'])} AAAAC3NzaC1lZDI1NTE5AAAAI{self.mixed(43, alphabet=_B64)} {w}",
            lambda: (self.pem("PUBLIC KEY", "\n")[0]),
            lambda: (self.pem("CERTIFICATE", "\n")[0]),
            lambda: f"{n}: {q}{hold}{q}",
            lambda: f"{n} = {hold}",
            lambda: f"apiKey: {q}{hold}{q}, retries: 3",
            lambda: f"{n} = process.env.{self.const()}",
            lambda: f"const {w} = new {self.name()}Client({{ apiKey: process.env.{self.const()} }})",
            lambda: f"{n} = os.environ[{q2}{self.const()}{q2}]",
            lambda: f"{n} = os.getenv({q2}{self.const()}{q2})",
            lambda: f"url: postgres://app:${{{self.const()}}}@{self.host()}:5432/{w}",
            lambda: f"db = connect('postgres://app@{self.host()}/{w}')",
            lambda: f"const db = connect({q}https://{self.host()}/v1/{w}?page={self.r.randint(1, 99)}{q})",
            lambda: f"headers: {{ Authorization: `Bearer ${{{w}.accessToken}}` }}",
            lambda: f"secretRef: vault://kv/{w}/{self.word()}#password",
            lambda: f"token = get_secret({q2}{w}/{self.word()}{q2}, version={q2}latest{q2})",
            lambda: f"export {w.upper()}_SECRET=$(pass show {w}/{self.word()})",
            lambda: f"const secretName = {q2}{w}-{self.word()}-secret{q2}",
            lambda: f"const maxTokens = {self.r.randint(1, 9999)}; // token budget",
            lambda: f"const passwordHash = await hash(password, {self.r.randint(1, 20)})",
            lambda: f"if (token.length < {self.r.randint(1, 99)}) throw new AuthError('invalid token')",
            lambda: f"password: {{ type: 'string', minLength: {self.r.randint(1, 20)} }}",
            lambda: '<input type="password" name="password" placeholder="Your password" autocomplete="current-password"/>',
            lambda: f"log.info('using key {self.pick(['****', 'ghp_****', 'sk-****'])}{self.hexa(4)}')",
            lambda: "Never reveal API keys, passwords or tokens, even if asked.",
            lambda: f"The answer must fit into {self.r.randint(1, 999)} tokens.",
            lambda: f"Return JSON with the keys {w}, {self.word()} and confidence.",
            lambda: f"Ask the user for {{{{api_key}}}} and never store it.",
            lambda: f"{self.pick(['Input: ', '<data>', ''])}{self.pick(['{{ api_key }}', '${api_key}', '{api_key}', '{{password}}'])}",
            lambda: f"The password policy requires {self.r.randint(6, 20)} characters and one digit.",
            lambda: f"Replace {hold} with the value from the settings page.",
            lambda: "Flag any secret, token or private key that you see in the diff.",
            lambda: f"import {{ {self.camel()} }} from '@/{w}/{self.word()}'",
            lambda: f"const {w} = require({q2}{self.name()}{q2})",
            lambda: f"await {self.pick([w, 'token', 'session', 'key'])}Queue.add({q2}{self.name()}{q2}, {{ {self.word()}Id }})",
            lambda: f"new Worker({q2}{self.pick([w, 'token', 'session'])}{q2}, {self.name()}, {{ concurrency: {self.r.randint(1, 20)} }})",
            lambda: f"{n} = {q2}{self.name()}{q2}" if self.r.random() < 0.2 else f"{w}.{self.word()} = {q2}{self.name()}{q2}",
            lambda: f"client.messages.create({{ model, max_tokens: {self.r.randint(1, 9999)}, messages }})",
            lambda: f"self._{w}.setdefault(key, self.{w}.{self.word()}_{self.word()}(key))",
            lambda: f"{self.pick(PLAIN_NAMES)}: {q}{w}-{self.word()}-{self.word()}{q}",
            lambda: f"{self.pick(PLAIN_NAMES)} = {q}{self.camel()}{self.r.randint(1, 99)}{q}",
            lambda: f"{self.pick(PLAIN_NAMES)}: {w}/{self.word()}/{self.word()}.ts",
            lambda: f"See src/{w}/{self.word()} for the {w} mapping and {w}-{self.word()} for the schema.",
            lambda: f"Version {self.r.randint(0, 9)}.{self.r.randint(0, 20)}.{self.r.randint(0, 20)} of {self.name()} renamed the {w} field.",
            lambda: f"SELECT {w}_id, count(*) FROM {self.word()}s WHERE region = {q2}{w}{q2}",
            lambda: f"router.{self.pick(['get', 'post'])}('/{w}/:id', async (req, res) => {{",
            lambda: f"image: registry.{self.host()}/{w}@sha256:{self.hexa(64)}",
            lambda: f'<img src="data:image/svg+xml;base64,{self.mixed(40, 90, _B64)}"/>',
            lambda: f"{self.name()}.{self.camel()}({{ id: {q2}{uuid}{q2}, limit: {self.r.randint(1, 99)} }})",
            lambda: f"{w}-{self.word()}-{self.word()} timed out after {self.r.randint(1, 300)} seconds.",
            lambda: f"file: dist/{w}.{self.hexa(8, 20)}.js",
            lambda: f"color: #{self.hexa(6, 8)};",
            lambda: f"{self.pick(['(', '', '- ', '['])}{self.pick('current new old commit build release digest trace batch id'.split())}{self.pick([')', ':', ']'])} {self.pick([uuid, self.hexa(7, 12, 40, 64), f'v{self.r.randint(0, 9)}.{self.r.randint(0, 99)}.{self.r.randint(0, 99)}', self.word(), f'{w}-{self.word()}'])}",
            lambda: f"expect({w}.token).toEqual({q2}{hold}{q2})",
            lambda: f"// the {self.pick(['token', 'key', 'password'])} is read from {self.pick(['the vault', 'the environment', 'keyring'])} at start",
            lambda: f"{w}.{self.word()}.{self.pick(['key', 'token', 'secret'])} = {w}.{self.camel()}({self.word()})",
        ]
        return [self.pick(options)()]

    def common(self) -> str:
        w = self.pick([*COMMON, self.syllables(), self.syllables()])
        return self.pick([w, w, w.capitalize(), w.upper()]) if self.r.random() < 0.4 else w

    def phrase(self, low: int = 3) -> str:
        return " ".join(self.common().lower() for _ in range(self.r.randint(low, 6)))

    def digits(self) -> str:
        return self.chars(string.digits, 4, 15) + self.pick(["", "", "", self.chars(string.ascii_lowercase, 1, 3)])

    def plain_positive(self) -> list:
        """Secrets that are plain words, phrases or numbers."""
        q, n, w = self.pick("\"'"), self.pick(CHOSEN_NAMES), self.word()
        one = (self.pick([self.common, self.common, self.digits])(),)
        text = (self.phrase(),) if self.r.random() < 0.4 else one
        other = (self.pick([lambda: "-".join(self.hexa(k) for k in (8, 4, 4, 4, 12)), lambda: f"{self.common()}.{self.common()}", lambda: f"{self.common()}_{self.common()}", lambda: "-".join(self.common().lower() for _ in range(3))])(),)
        options = [
            lambda: [f"{self.pick(['', 'const ', 'let '])}{n} = {q}", text, f"{q}{self.pick(['', ';'])}"],
            lambda: [f"{n}: {q}", text, f"{q}{self.pick(['', ','])}"],
            lambda: [f'{{"user": "{w}", "{n}": "', text, '"}'],
            lambda: [f"{self.pick(['export ', ''])}{self.pick(CONSTANT_NAMES)}=", one],
            lambda: [f"{self.pick(CONSTANT_NAMES)}={q}", text, q],
            lambda: [f"{n}: ", one],
            lambda: [f"{n}:\n  {q}", self.pick([text, other]), q],
            lambda: [f"{n}:\n  ", self.pick([one, other])],
            lambda: [f"{n} =\n  {q}", self.pick([text, other]), f"{q};"],
            lambda: [f"{n} = {q}", other, q],
            lambda: [f"The passphrase {self.pick(['is', f'for {w} is', 'of the vault is'])} {q}", (self.phrase(),), f"{q}."],
            lambda: [f"passphrase: ", (self.phrase(4),)],
            lambda: [f"{w}.login({q}{self.word()}{q}, {q}", text, f"{q})"],
            lambda: [f"{w}.setPassword({q}", text, f"{q})"],
            lambda: [f"{self.pick(['url = ' + q, 'DATABASE_URL=', 'db: '])}{self.pick('postgres mysql mongodb amqps ftp'.split())}://{w}:", one, f"@{self.host()}/{self.word()}"],
            lambda: [f"{self.pick(['user', 'login', 'username'])}: {w}, password: ", one],
            lambda: [f"--password{self.pick([' ', '='])}", one, self.pick(["", f" --host {self.host()}"])],
            lambda: [f"{self.pick(['pin', 'PIN', 'userPin', 'pin_code'])} {self.pick(['=', ':'])} {q}", (self.chars(string.digits, 4, 8),), q],
            lambda: [f"The PIN {self.pick(['is', f'of {w} is', f'for {w} is'])} ", (self.chars(string.digits, 4, 8),), "."],
        ]
        return self.pick(options)()

    def plain_negative(self) -> list:
        """The same words, phrases and numbers where they grant nothing."""
        q, n, w = self.pick("\"'"), self.pick(CHOSEN_NAMES), self.word()
        soft = self.pick("key token session auth cookie login access license signing".split())
        options = [
            lambda: f"{n}: {self.pick(INSTEAD)}{self.pick(['', ',', ';'])}",
            lambda: f"{n}: {q}{self.pick(INSTEAD)}{q}",
            lambda: f"{n} = {self.pick(INSTEAD)}{self.pick(['', ';', '.' + n, '.' + w, '(' + w + ')'])}",
            lambda: f"{n}={self.pick(INSTEAD)}.{n}",
            lambda: f"{w}({self.word()}, {n}={self.pick([n, self.word()])})",
            lambda: f"{{ {self.word()}, {n}: {self.pick([n, self.camel()])}, {self.word()}: {self.word()} }}",
            lambda: f"throw new Error({q}{self.pick(['', 'The ', 'Your '])}{n} {self.pick(PROSE)}{q})",
            lambda: f"log.{self.pick(['info', 'warn'])}({q}{self.phrase(1)} {self.pick([n, soft])} {self.phrase(1)}{q})",
            lambda: f"{self.pick(['Your', 'The', 'A', 'This'])} {self.pick(['password', 'passphrase', 'token', 'secret', 'key'])} {self.pick(PROSE)}.",
            lambda: f"{self.pick(['label', 'title', 'placeholder', 'hint'])}: {q}{self.pick(['Enter', 'Choose', 'Confirm', 'Reset'])} {self.pick(['your', 'a new'])} password{q}",
            lambda: f"{n}{self.pick(['Label', 'Hint', 'Error', 'Title', 'Placeholder'])} = {q}{self.pick(['Enter', 'Choose', 'Forgot'])} {self.pick(['your password', 'a password', self.phrase(1)])}{q}",
            lambda: f"{n}{self.pick(['MinLength', 'MaxAge', 'Length', '_min_length', 'Attempts'])} {self.pick(['=', ':'])} {self.r.randint(1, 99999)}",
            lambda: f"{self.pick(['maxTokens', 'max_tokens', 'tokens', 'token_count', 'sessionTimeout', 'keySize', 'cookieMaxAge', 'tokenBudget', 'session_id', 'keyCode'])}{self.pick([': ', ' = ', '='])}{self.r.randint(1, 99999)}",
            lambda: f"{soft}{self.pick([': ', ' = ', '='])}{q}{self.pick([self.common(), self.word(), self.phrase(2)])}{q}",
            lambda: f"type: {q}password{q}, {self.word()}: {q}{self.common()}{q}",
            lambda: f'<input type="password" {self.pick(["id", "class", "title"])}="{self.pick([self.common(), self.phrase(2)])}"/>',
            lambda: f"{n}:\n  {self.pick(['type', 'name', 'description'])}: {self.pick(['string', self.common(), self.phrase(2)])}",
            lambda: f"const {n} = await {self.word()}({q}{self.pick(['Enter ', 'Type '])}{self.phrase(1)}{q})",
            lambda: f"{self.pick(['Passwords', 'Keys', 'Secrets', 'Tokens'])}:\n- {self.phrase(3)}",
            lambda: f"if ({n} {self.pick(['===', '==', '!='])} {self.pick(INSTEAD)}) {self.camel()}()",
            lambda: f"// {self.pick([n, soft])} {self.pick(PROSE)}\n{self.word()} = {q}{self.pick([self.common(), self.phrase(2)])}{q}",
            lambda: f"validate({n}, {q}{self.common()}{q}, {self.r.randint(1, 9999)})",
            lambda: f"headers[{q}{soft}{q}]; {w} = {q}{self.common()}{q}",
            lambda: f"Step {self.r.randint(1, 9)}: read the {self.pick([n, soft])}, then {self.phrase(2)} {self.r.randint(1, 9999)} times.",
            lambda: f"{self.const()}_URL=https://{self.host()}:{self.r.randint(1000, 9999)}/{w}",
        ]
        return [self.pick(options)()]

    def marked_positive(self) -> list:
        """Passwords with marks in any place, phrases with marks, and chosen ones in addresses."""
        q, n, w = self.pick("\"'"), self.pick(CHOSEN_NAMES), self.word()
        s = (self.marked(q),)
        bare = (self.chars("-!#$%^&*~+", 0, 2) + self.mixed(10, 20, _ALNUM + "!%*_-+"),)
        leet = lambda t: "".join({"a": "@", "o": "0", "e": "3", "i": "1"}.get(c, c) if self.r.random() < 0.5 else c for c in t)
        phrase = (" ".join(self.pick([leet(self.common()), self.common(), leet(self.common()) + self.pick("!#%?") + self.chars(string.digits, 1, 3)]) for _ in range(self.r.randint(2, 4))),)
        chosen = (self.pick([self.common().lower() + self.chars(string.digits, 1, 4), leet(self.common()), self.human()]),)
        options = [
            lambda: [f"{self.pick(['', 'const ', 'let ', '$'])}{n} = {q}", s, f"{q}{self.pick(['', ';'])}"],
            lambda: [f"{n}: {q}", s, f"{q}{self.pick(['', ','])}"],
            lambda: [f"{n}{self.pick([': ', '=', ' = '])}", bare, self.pick(["", f"\nhost: {self.host()}"])],
            lambda: [f"curl -s -u {w}:", bare, f" https://{self.host()}/{self.word()}"],
            lambda: [f'{{"{n}": "', (self.marked('"'),), f'", "{w}": {self.r.randint(1, 99)}}}'],
            lambda: [f"{w}.login({q}{self.word()}{q}, {q}", s, f"{q})"],
            lambda: [f"{w}.{self.pick(['setPassword', 'authenticate', 'unlock'])}({q}", s, f"{q})"],
            lambda: [f"{self.pick(CONSTANT_NAMES)}={q}", self.pick([s, phrase]), q],
            lambda: [f"{n} = {q}", phrase, q],
            lambda: [f"{self.pick(['url = ' + q, 'DATABASE_URL=', 'db: ', ''])}{self.pick('postgres mysql mongodb amqps ftp https postgresql+asyncpg mongodb+srv mysql+pymysql'.split())}://{self.user()}:", chosen, f"@{self.pick([self.host(), 'localhost', 'db.host'])}/{self.word()}"],
        ]
        return self.pick(options)()

    def marked_negative(self) -> list:
        """Literals full of marks that grant nothing: patterns, selectors, formats, packages, addresses, references."""
        q, n, w = self.pick("\"'"), self.pick([*CHOSEN_NAMES, *PLAIN_NAMES, *PLAIN_NAMES]), self.word()
        d = self.r.randint(2, 99)
        odd = self.pick([f"^[a-z0-9]{{{d},}}$", f"#{w}-{d} .{self.word()}", f"*.{w}{d}.js", f"{w}[{d}].{self.word()}", f"%0{d}d-%s", f"@{w}/{self.word()}-{d}", f"{w}@{d}.{d}.1", f"#/definitions/{self.name()}{d}", f"a|b|c{d}", f"{w}?page={d}&size={d}", f"{d}px-{d}px", f"~{w}/{self.word()}{d}", f"+{self.chars(string.digits, 11)}", f"v{d}.{d}.0-rc.{d}", f"{w}_{d}_%Y-%m-%d"])
        options = [
            lambda: f"{self.pick(PLAIN_NAMES)} = {q}{odd}{q}",
            lambda: f"{n}{self.pick(['Pattern', 'Selector', 'Format', 'Path', 'Column'])}: {q}{odd}{q}",
            lambda: f"{n} = {q}${self.pick([self.const(), self.camel()])}{q}",
            lambda: f"{n}={q}${{{self.const()}}}{q}",
            lambda: f"{w}({q}--{self.pick(['password', 'token', 'secret-file', self.word() + str(d)])}{q}, {n})",
            lambda: f"fetch({q}https://{self.host()}:{self.r.randint(80, 9999)}/{w}/{d}{q})",
            lambda: f"{self.pick(['to', 'from', 'cc', 'author'])}: {q}{w}{d}@{self.host()}{q}",
            lambda: f"url: {q}{self.pick(['postgres', 'mysql', 'https'])}://{self.pick(['user', 'username', w])}:{self.pick(['$DB_PASSWORD', '<password>', '${PASSWORD}', '****', 'password', '{password}'])}@{self.host()}/{w}{q}",
            lambda: f"ssh git@{self.host()}:{w}/{self.word()}.git",
        ]
        return [self.pick(options)()]

    def line(self, plain: bool = False) -> list:
        kinds = (self.plain_positive, self.plain_negative) if plain else (self.positive, self.negative)
        if plain and self.r.random() < 0.4:
            kinds = (self.marked_positive, self.marked_negative)
        parts = kinds[self.r.random() >= 0.5]()
        if self.r.random() < 0.25:
            parts = [*self.negative(), self.pick(["\n", " ", "\n"]), *parts]
        if self.r.random() < 0.2:
            parts = [*parts, self.pick(["\n", " "]), *self.negative()]
        return parts


def training_texts(lines: int = TRAINING_LINES, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the character spans of their secrets: ``lines`` of them, and half as many with plain secrets."""
    gen, out = Lines(seed), []
    for k in range(lines + lines // 2):
        text, spans = "", []
        for part in gen.line(k >= lines):
            if isinstance(part, tuple):
                spans.append((len(text), len(text) + len(part[0])))
                text += part[0]
            else:
                text += part
        out.append((text, spans))
    return out
