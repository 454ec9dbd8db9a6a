"""Texts to judge the residue operator by: none of them comes from the test tables."""

NOTICES = """
This site requires JavaScript to run properly.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
Cette page nécessite JavaScript.
Please turn on JavaScript in your browser settings and reload the page.
JavaScript must be enabled in order for you to view this site.
It looks like your browser has cookies disabled. Please enable cookies and try again.
Your browser does not support JavaScript! Scripts are required to display this chart.
For full functionality of this site it is necessary to enable JavaScript.
404. That's an error. The requested URL /wiki/index was not found on this server.
Error 404: Page Not Found
HTTP 500 - Internal Server Error
500 Internal Server Error nginx/1.18.0
503 Service Temporarily Unavailable
HTTP/1.1 403 Forbidden
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.
The document you requested could not be found.
Oops! Something went wrong. Please try again later.
Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed.
This content is not available in your country. You do not have permission to access it.
You are not authorized to view this page.
Your session has expired. Please log in again.
Your session timed out due to inactivity.
The connection has timed out. The server is taking too long to respond.
Checking your browser before accessing the forum.
Please verify you are a human by completing the captcha below.
Our systems have detected unusual traffic from your computer network.
This website is currently down for maintenance. We will be back shortly.
The server is busy. Please retry in a few minutes.
Unable to connect to the database. Contact the site administrator.
An unexpected error occurred while processing your request.
Bitte aktivieren Sie JavaScript, um diese Website zu nutzen.
Die angeforderte Seite wurde nicht gefunden.
Der Dienst ist zurzeit nicht verfügbar. Bitte versuchen Sie es später erneut.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
La page demandée est introuvable.
Une erreur est survenue. Veuillez réessayer plus tard.
Votre navigateur n'accepte pas les cookies. Veuillez activer les cookies.
您访问的页面不存在或已被删除。
网络异常，请稍后重试。
请开启浏览器的JavaScript功能后再访问。
服务器内部错误，请联系管理员。
Страница не найдена. Вернуться на главную
Пожалуйста, включите JavaScript в вашем браузере.
La página solicitada no existe. Inténtelo de nuevo más tarde.
पृष्ठ नहीं मिला। कृपया पुनः प्रयास करें।
Хуудас олдсонгүй. Дахин оролдоно уу.
དྲ་ངོས་རྙེད་མ་སོང་། ཡང་བསྐྱར་ཚོད་ལྟ་གནང་རོགས།
""".strip().split("\n")

KEPT = """
Mustache uses {{title}} to mark a slot. The engine replaces it when the page is rendered.
In Jinja, a variable such as {{ user.name }} is printed by the template engine.
The syntax ${name} stands for the value of a variable in a template string.
Der Platzhalter {{titel}} steht für den Titel des Dokuments.
Write `{{ message }}` in the markup and the framework fills it in.
Un espace réservé comme {{ nom }} est remplacé par le nom du client.
模板中的占位符 {{title}} 表示文章标题。
Set the greeting first:\\n\\n    <p>{{ greeting }}</p>\\n\\nThen reload and look at the result.
```html\\n<h1>{{ title }}</h1>\\n```\\nThe heading is filled in by the server.
<pre>Hello ${first_name}</pre> is what the mail merge example looks like.
The manuscript breaks off here [illegible] and resumes on the next leaf [sic].
Choose an option from the menu (see page 4) and press the key <b>Enter</b>.
The function returns a[i] for each index, where {a, b} is the set of ends.
Yesterday I got a 404 when I opened the old address, so I wrote to the library.
A 404 error means that the server could not find the page.
Status code 503 tells the client that the service is overloaded; crawlers then wait.
The museum's site was down for maintenance on Monday, he said.
When the catalogue answered with "Internal Server Error" we waited an hour.
She said "page not found" was the saddest phrase on the web.
The phrase 'please enable JavaScript' appears on many old sites.
Some visitors turn JavaScript off for safety, and the archive respects that.
JavaScript was created in ten days in 1995. It is now used on most sites.
The word error comes from the Latin errare, to wander.
The king denied access to the treasury, and the envoys returned home.
The session of the council ended at noon. The members went to lunch.
The lost page was not found until 1932, when the monastery was repaired.
No trace of the second volume was found in the collection.
His request was refused because the abbot was away.
Cookies are best baked at a low heat and should be allowed to cool.
The gate of the server room was blocked by snow for two days.
Lorem ipsum is a text that printers have used since the 1500s.
Designers use filler text so that readers look at the layout and not at the words.
The coming soon sign hung over the shop for years.
Die Seite 404 der Handschrift ist beschädigt.
Der Server der Bibliothek war gestern nicht erreichbar, sagte sie.
Le serveur de la bibliothèque était indisponible hier.
他昨天说服务器出现错误，所以没有上传稿件。
The test was hard, and the bar was high; the dummy was made of straw.
He tried again and again until the ink held.
Readers who return to the start of the text find the same prayer there.
The browser war of the 1990s was won by a company that no longer exists.
The text is here called a placeholder for the deity.
""".strip().split("\n")

TUTORIAL = " ".join(f"Step {k}: the template engine reads the variable from the context and renders the tag as HTML." for k in range(40)) + " Now the page says {{ message }} to you. " + " ".join(
    f"Exercise {k}: write a function that returns a string." for k in range(40)
)
ERROR_GUIDE = "The status codes of HTTP are sent by the server to the client. A response in the 200s is a success. " * 10 + "Error 404: not found. The browser shows the response to the user."
LEFTOVERS = """
Dear {{first_name}}, thank you for your order of the prayer book.
Welcome to [COMPANY_NAME], home of fine woodblocks.
Posted on %%date%% by %%author%%
Your content goes here.
Click to add title
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
This is a sample page. It is different from a blog post.
Insert your text here.
Hier steht bald Ihr Text.
Saisissez votre texte ici.
请在此处输入内容。
The lama sat by the lake. ${body_text} He went home in spring.
""".strip().split("\n")
